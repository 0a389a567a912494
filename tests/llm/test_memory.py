"""A step of the quality operator takes a bounded piece of memory, and what was shuffled for a cut goes at once."""

import time
import tracemalloc

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from paceline.llm import common, importance, jaccard
from paceline.llm.bpe import WordBpe, decode_notes, encode_notes
from paceline.llm.common import WordHashes, cut, small_batches, text_batches
from paceline.llm.queries_text import as_attempts, vocabulary


def test_ngrams_of_a_step_are_few():
    frame = pd.DataFrame({"text": [" ".join(f"word{i * 997 + j}" for j in range(1000)) for i in range(150)]})
    known = WordHashes()
    tracemalloc.start()
    for _, words in text_batches([frame], "text", False, importance.WORDS):
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        importance.features(words, known)
        assert tracemalloc.get_traced_memory()[1] - before < 25_000_000
    tracemalloc.stop()


def sizes(batches):
    for frame in batches:
        yield pd.DataFrame({"n": [len(frame)]})


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []

    def noted(df):
        seen.append(int(spark.conf.get(name)))
        return cut(df)

    monkeypatch.setattr(importance, "cut", noted)
    notes = spark.createDataFrame([(i, f"note {i % 7} of {i % 5}") for i in range(300)], "attempt_id long, notes string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "attempt_id long, usable int")
    assert importance.sample_usable_notes(notes, labels).count() == 300
    assert len(seen) == 2 and max(seen) <= common.TEXTS_AT_ONCE
    with small_batches(spark):
        assert max(r.n for r in spark.range(0, 5000, 1, 1).mapInPandas(sizes, "n long").collect()) <= common.TEXTS_AT_ONCE
    assert spark.conf.get(name) == before


def test_shuffles_of_a_cut_are_deleted(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    rows = cut(spark.range(10_000).groupBy((F.col("id") % 1009).alias("k")).count())
    end = time.time() + 10
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before
    assert rows.count() == 1009 and rows.agg(F.sum("count")).first()[0] == 10_000


def test_tokens_take_one_python_operator(spark):
    """Two in one stage would keep twice the workers, and an encoder in each."""
    path = vocabulary()
    docs = spark.createDataFrame([(1, "One lap of the course", "en", "s"), (2, None, "en", "s"), (None, "İ \u00e9 1,5 s", "en", "s")], "doc_id long, text string, lang string, source string")
    found = corpus_pipeline.tokens(spark, docs, "")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    apart = decode_notes(encode_notes(as_attempts(docs), path), path)
    assert sorted(map(tuple, found.select("doc_id", "n_tokens", "token_ids", "text").collect()), key=str) == sorted(map(tuple, apart.select("attempt_id", "n_tokens", "token_ids", "notes").collect()), key=str)
    own = WordBpe(path)
    own.encode("one lap")
    own.forget()
    assert not own.of_token and not own.pairs


def test_blocks_are_compared_in_rounds(spark, monkeypatch):
    """Rounds of few pairs find the same groups as one round with all pairs."""
    words = [f"w{i * 7919 % 1013}" for i in range(120)]
    texts = [(i, " ".join(words[: 60 + i] + [f"x{i % 3}"])) for i in range(40)] + [(100 + i, " ".join(reversed(words[i:]))) for i in range(30)]
    notes = spark.createDataFrame(texts, "attempt_id long, notes string")
    groups = []
    for copies in (1e9, 0.2):
        monkeypatch.setattr(jaccard, "ROUND_COPIES", copies)
        groups.append(sorted(map(tuple, jaccard.near_duplicate_notes(notes, shingle_words=5, percent=80).collect())))
    assert groups[0] == groups[1] and len(groups[0]) == 70


def test_rounds_of_signatures_and_sketches_lose_no_link(spark, monkeypatch):
    """Signatures and the sketches of keys are shipped in rounds, however few; groups are those of all pairs."""
    import random

    import paceline.llm.jaccard as J
    from tests.llm.test_texts import brute_components
    rnd = random.Random(11)
    texts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(20, 120))) for _ in range(60)]
    near = lambda t: " ".join(w if rnd.random() > 0.02 else "other" for w in t.split())
    docs = list(enumerate(texts + [near(t) for t in texts[:30] for _ in range(3)] + [texts[3], None, "", "a b"]))
    held = spark.createDataFrame(docs, "attempt_id long, notes string").repartition(3)
    monkeypatch.setattr(J, "ROUND_SIGNATURES", 0.2)
    monkeypatch.setattr(J, "ROUND_ROWS", 0.02)
    parts, sieves = [], []
    real = J.cut

    def counted(df):
        parts.append(df.columns == ["key", "node"])
        sieves.append(df.columns == ["node", "block", "other"])
        return real(df)

    monkeypatch.setattr(J, "cut", counted)
    got = sorted((r[0], r[2]) for r in J.near_duplicate_notes(held, shingle_words=3, percent=80).collect())
    assert got == sorted((n, c) for n, _, c in brute_components(docs, 3, 80)) and len({c for _, c in got}) < len(docs) - 30
    assert sum(parts) > 1 and sum(sieves) > 1
