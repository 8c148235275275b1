import random

from weftgraph.llm import licenses as L
from weftgraph.llm.queries import op5_license_scan as op5


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(texts):
    """Every window of every text, whatever words it holds."""
    out = {}
    for d, t in enumerate(texts):
        s = shingles(L.words_of(t or ""))
        for name, _, text in L.TEMPLATES:
            known = set(shingles(L.words_of(text)))
            n = max(1, len(L.words_of(text)) - 4)
            step = max(1, n // 4)
            for start in range(0, len(s), step):
                c = len(known.intersection(s[start : start + n + step])) / len(known)
                if c >= 0.75 and c > out.get((d, name), (0, 0))[0]:
                    out[d, name] = (c, start)
    return out


def test_key_words_are_needed():
    for _, _, text in L.TEMPLATES:
        w = L.words_of(text)
        keys = L.key_words(w)
        s = set(shingles(w))
        assert sum(not keys.intersection(x) for x in s) < 0.75 * len(s)


def test_against_all_windows(spark, make_docs):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(200)] + ["license", "licensed", "software", "permission", "public"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = []
    for _, _, text in L.TEMPLATES:
        w = text.split()
        for edits in (0, 1, 2, 4):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = "other"
            texts.append(f"{say(rng.randint(0, 90))} {' '.join(v).upper()}\n{say(rng.randint(0, 90))}")
            texts.append(" ".join(v[: max(3, len(v) * 3 // 4)]))
    texts += [None, "", "license", "the MIT License", say(3000), texts[0], "Licensed under CC BY-SA 4.0."]
    _, d = make_docs(texts, extra={"template": "string", "words": "int"})
    got = {(r.doc_id, r.template): (r.containment, r.start_word) for r in op5(spark, d).collect()}
    assert got == brute(texts)


def test_empty_table_and_null_ids(spark, make_docs):
    _, d = make_docs([])
    assert op5(spark, d).count() == 0
    _, d = make_docs(["Released under the MIT License."] * 2, ids=[None, None])
    assert [(r.doc_id, r.template, r.n_windows) for r in op5(spark, d).collect()] == [(None, "mit-notice", 1)]
    docs, _ = make_docs(["x"])
    assert L.license_matches(docs, templates=()).count() == 0


def test_notices_of_fewer_words_than_a_shingle(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(400))
    texts = [
        "All rights reserved.", "(c) 2024 Ada. ALL RIGHTS\nRESERVED!", f"{long} All rights reserved. {long}", "all rights", "reserved all rights",
        "all their rights reserved", "rights reserved", f"{long} reserved", None, "", "Released under the MIT License. All rights reserved.",
    ]
    _, d = make_docs(texts)
    got = {(r.doc_id, r.template) for r in op5(spark, d).collect()}
    assert got == {(i, "rights-reserved") for i in (0, 1, 2, 10)} | {(10, "mit-notice")}
    docs, _ = make_docs(["x y z", "say no derivatives now", f"{long} one two three four {long}", "one two three"])
    own = (("a", "A", "no derivatives"), ("b", "B", "one two three four"), ("c", "C", "x"), ("d", "D", ", ."))
    assert {(r.doc_id, r.template, r.containment) for r in L.license_matches(docs, own).collect()} == {(0, "c", 1.0), (1, "a", 1.0), (2, "b", 1.0)}
