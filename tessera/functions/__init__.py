from . import cs, ts  # noqa: F401
