"""What a bound on memory must not change."""

import random

from fathomry.llm import lm_score, url_filter


def test_lm_words_without_a_code_keep_their_counts(spark, monkeypatch):
    """Scores are the same whether all words or only the most frequent have a code on the workers (more than the network predicts, either way)."""
    monkeypatch.setattr(lm_score, "WORDS", 48)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(1100)] * 3 + [f"x{k}" for k in range(300)] * 2 + [f"y{k}" for k in range(300)]
    rng.shuffle(words)
    rows = [(k, " ".join(words[k * 30 : k * 30 + 30])) for k in range(len(words) // 30 + 1)] + [(3, words[0]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    few, all_of = (sorted((str(r.doc_id), r.n_tokens, r.pll) for r in lm_score.pseudo_likelihood(docs, known).collect()) for known in (1101, 5000))
    assert len(few) == len(rows) and [r[:2] for r in few] == [r[:2] for r in all_of]
    assert all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(few, all_of, strict=True))
    counts = lm_score.count_words(docs)
    lexicon = lm_score.lexicon_of(counts, 1101)
    assert len(lexicon.known) == 1100 and counts.count() == 1700


def test_url_words_keep_their_counts(spark):
    """60,000 words seen once each: hosts made of them are split into them."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randrange(8, 10))) for _ in range(60_000)})
    rng.shuffle(words)
    rows = [(k, f"http://www.{words[k]}{words[k + 200]}.org/{words[k + 400]}", " ".join(words[k::100])) for k in range(100)]
    got = {r.page_id: r.words for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"host:{words[k]} host:{words[k + 200]} path:{words[k + 400]}" for k in range(100)}
