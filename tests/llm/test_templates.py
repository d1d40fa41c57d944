"""Decontamination against a plain matcher over all pairs of documents and items."""

from __future__ import annotations

import random
from collections import defaultdict

import regex
from tessera.llm import decontaminate as D
from tessera.llm import quality

from .test_llm import docs_of

_KINDS = regex.compile("|".join(D.KINDS))
_NUMBER = regex.compile(D._NUMBER)


def template(text):
    """Tokens with and without their values."""
    plain, values = [], []
    for m in _KINDS.finditer(text.replace("€", "$").replace("£", "$")):
        x = m[0]
        if x[0] >= ":":
            plain.append(x.lower())
            values.append(x.lower())
        elif x[0] == " ":
            plain.append("⟨p⟩")
            values.append(f"⟨p·{x.lstrip().lower()}⟩")
        else:
            kind = "q" if x[0] == "$" or not x[-1].isdigit() else "n"
            plain.append(f"⟨{kind}⟩")
            values.append(f"⟨{kind}·{_NUMBER.search(x)[0]}⟩")
    return plain, values


def brute(docs, items):
    """(doc, item) -> exact, by templates alone."""
    found = {}
    for item, t in items:
        for form in {t or "", ", " + (t or "").lstrip(" ")}:
            tok, iv = template(form)
            if len(tok) < 4:
                continue
            n = min(8, len(tok))
            windows = {i: tuple(tok[i : i + n]) for i in range(len(tok) - n + 1) if sum(not x.startswith("⟨") for x in tok[i : i + n]) >= min(n, 3)}
            for doc, text in docs:
                dt, dv = template(text or "")
                at = defaultdict(set)
                for j in range(len(dt) - n + 1):
                    for i, w in windows.items():
                        if tuple(dt[j : j + n]) == w:
                            at[j - i].add(i)
                for diagonal, hit in at.items():
                    if len(hit) < min(len(windows), 5):
                        continue
                    places = {i + k for i in hit for k in range(n) if any(x.startswith("⟨") for x in windows[i])}
                    there, back, same = defaultdict(set), defaultdict(set), True
                    for i in sorted(places):
                        if iv[i].startswith("⟨"):
                            a, b = iv[i], dv[i + diagonal]
                            if i == 0 and b.endswith(" " + a[3:]) or i == len(iv) - 1 and b.startswith(a.rstrip("⟩") + " "):
                                b = a
                            there[a].add(b)
                            same = same and a == b
                            if a.startswith("⟨p·"):
                                back[b].add(a)
                    if all(len(x) == 1 for x in [*there.values(), *back.values()]):
                        found[doc, item] = found.get((doc, item), False) or same
    return found


def test_templates_against_all_pairs(spark):
    rng = random.Random(4)
    names, units = ["Peter", "Anna-Maria", "McDonald", "O'Brien", "Li", "New York"], ["km", "kg", "%", "", "minutes"]
    words = "train leaves the station and meets another at noon while it rains over there".split()

    def ask():
        parts = []
        for _ in range(rng.randrange(4, 22)):
            kind = rng.random()
            parts.append(rng.choice(names) if kind < 0.15 else f"{rng.randrange(2, 9)} {rng.choice(units)}".strip() if kind < 0.3 else rng.choice(words))
        return " ".join(parts)

    def changed(text):
        numbers, people = {str(i): str(rng.choice([i, i + 10, 3])) for i in range(10)}, dict(zip(names, rng.choices(names, k=6), strict=True))
        if rng.random() < 0.5:
            people = dict(zip(names, rng.sample(names, 6), strict=True))
        text = regex.sub("|".join(names), lambda m: people[m[0]], text)
        return regex.sub("[0-9]", lambda m: numbers[m[0]] if rng.random() < 0.95 else "7", text)

    items = [(i, ask()) for i in range(30)] + [(30, None), (31, "")]
    docs = []
    for d in range(150):
        body = rng.choice(items[:30])[1]
        docs.append((d, f"{rng.choice(['so ', '', 'we saw Peter ', 'it cost $5, '])}{body if rng.random() < 0.3 else changed(body)}{rng.choice([' on', '.', ' Anna said so', ''])}"))
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in D.contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), least_exact=10**6).collect()}
    want = brute(docs, items)
    assert len(want) > 50 and not all(want.values())
    assert got == want


def test_names_stand_one_for_one(spark):
    item = "then Peter gave Maria 7 apples while Anna gave Peter the rest of them and left early"
    docs = {
        1: item,
        2: "then Alice gave Alice 7 apples while Alice gave Alice the rest of them and left early",
        3: "then O'Brien gave Anna-Maria 9 apples while McDonald gave O'Brien the rest of them and left early",
        4: "then Bob gave Carol 7 apples while Dora gave Bob the rest of them and left early",
    }
    got = D.contaminated(docs_of(spark, list(docs.items())), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["exact"]) for r in got) == [(1, True), (3, False), (4, False)]


def test_items_of_a_word_mark_nothing(spark):
    items = spark.createDataFrame([(1, "The"), (2, "A b"), (3, "Who won?"), (4, None)], "item_id long, text string")
    docs = docs_of(spark, [(1, "The end of the line"), (2, "a b c"), (3, "so who won?")])
    assert [(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()] == [(3, 3)]
    assert sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items, least_exact=2).collect()) == [(2, 2), (3, 3)]
    assert sorted(r["item_id"] for r in D.uncovered(items).collect()) == [1, 2, 4]


def test_clean_texts_of_other_languages_pass(spark):
    """Texts without a listed function word are left to the language stage."""
    arabic = " ".join(f"كلمة{i % 40} جملة{i % 35} نص{i % 50}" for i in range(40))
    hindi = " ".join(f"शब्द{'अआइईउऊ'[i % 6] * (1 + i % 7)} वाक्य{'कखगघ'[i % 4] * (1 + i % 9)}" for i in range(60))
    rare = "lorem " + " ".join(f"word{i}" for i in range(299)) + " the"  # one in 300: far below a language's share
    got = {r["doc_id"]: (r["kept"], r["failed"]) for r in quality.quality(docs_of(spark, [(1, arabic), (2, hindi), (3, rare)])).select("doc_id", "kept", "failed").collect()}
    assert "stop_words" not in got[1][1] and "stop_words" not in got[2][1] and got[3][1] == ["stop_words"]
