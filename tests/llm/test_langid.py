import random
import zlib

from weftgraph.llm import langid
from weftgraph.llm.queries import op4_language_id as op4

# Frequent words, enough to make toy languages of two families.
WORDS = {
    "en": "the of and to in that is was for with they this from have".split(),
    "de": "der die und das von zu den mit sich nicht auch ein werden schön".split(),
    "fr": "le la les des et en un une du que dans pour plus été".split(),
    "es": "el los las de que y por con una para como más ción niño".split(),
}


def said(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    langs = [rng.choice(list(WORDS)) for _ in range(n)]
    return [said(rng, g, rng.randint(4, 60)) for g in langs], langs


def test_held_out_accuracy(spark, make_docs):
    texts, langs = corpus()
    given = [None if i % 7 == 0 else g for i, g in enumerate(langs)]
    texts += [None, "", "12 34 !!", "der " * 30_000]
    given += ["en", "fr", "de", None]
    _, d = make_docs(texts, langs=given, extra={"score": "string", "lang_pred": "int"})
    got = {r.doc_id: r for r in op4(spark, d).collect()}
    assert len(got) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())
    right = [got[i].lang_pred == g for i, g in enumerate(langs)]
    assert sum(right) >= 0.97 * len(right)
    n = len(langs)
    assert [got[n + k].lang_pred for k in range(4)] == ["und", "und", "und", "de"]
    assert got[n].score == 0


def test_labels_and_ids_are_no_inputs(spark, make_docs):
    texts, langs = corpus(120)
    texts += texts[:20]
    _, d = make_docs(texts, langs=langs + [None] * 20)
    got = {r.doc_id: r for r in op4(spark, d).collect()}
    assert all((got[i].lang_pred, got[i].score) == (got[120 + i].lang_pred, got[120 + i].score) for i in range(20))


def test_nothing_to_learn_from(spark, make_docs):
    _, d = make_docs(["words here", None])
    assert {r.lang_pred for r in op4(spark, d).collect()} == {"und"}
    _, d = make_docs([])
    assert op4(spark, d).count() == 0
    _, d = make_docs(["words here", "more words", "and more", "yet more"] * 3, langs=["xx"] * 12)
    assert {r.lang_pred for r in op4(spark, d).collect()} == {"xx"}


def test_sample_is_bounded(spark, make_docs):
    texts, langs = corpus(300)
    df, _ = make_docs(texts, langs=langs)
    rows = langid.labelled_sample(df, ~langid.held_out(), 5, "doc_id", "text", "lang")
    assert sorted(set(x[0] for x in rows)) == ["de", "en", "es", "fr"] and len(rows) == 20


def test_batches_agree_with_single_texts():
    texts, langs = corpus(80)
    model = langid.fit(list(zip(langs, texts)))
    together = model.predict(texts + ["", "İİ é"])
    alone = [model.predict([t])[0] for t in texts + ["", "İİ é"]]
    assert [x[0] for x in together] == [x[0] for x in alone]
