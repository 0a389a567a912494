"""The corpus pipeline on small tables: each stage against brute force, and odd rows through all of them."""

import random

import pytest

pytest.importorskip("xxhash")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline
from paceline.llm.queries_text import vocabulary
from tests.llm.test_texts import brute_components, brute_passages, words_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(500)}"
    texts = [" ".join(word() for _ in range(rnd.randrange(30, 200))) for _ in range(150)]
    passage, item = " ".join(f"p{i}" for i in range(70)), " ".join(f"q{i}" for i in range(20))
    texts += [t + " " + passage for t in texts[:6]] + [texts[20] + " more", texts[20]] + [texts[30] + " " + item + " tail"] + [t + " vile vile2" for t in texts[40:80]] + [None, "", "a b"]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, "no id here", None, None, 3), (3, texts[3], "en", "s", 9)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("vile" in (t or ""))) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "decontaminate", "tokens"]
    before = rows(docs)
    kept = stages["quality"](spark, docs, folder)
    assert kept.columns == docs.columns and set(rows(kept)) <= set(before)
    assert not any("vile" in (r[1] or "") for r in rows(kept)) and kept.count() >= 0.9 * sum("vile" not in (r[1] or "") for r in before)
    groups = brute_components([(r[0], r[1]) for r in before], 5, 80)
    one = stages["near_duplicates"](spark, docs, folder)
    assert sorted((r[0] for r in rows(one)), key=str) == sorted({n for n, _, c in groups if n == c}, key=str)
    texts = brute_passages([(str(i), r[1]) for i, r in enumerate(before)], 50)
    changed = {int(n): t for n, _, gone, t in texts if gone}
    expected = sorted(((r[0], changed.get(i, r[1] or ""), r[2], r[3], len(changed[i]) if i in changed else r[4]) for i, r in enumerate(before)), key=str)
    assert rows(stages["repeated_passages"](spark, docs, folder).select(docs.columns)) == expected and len(changed) >= 6
    cut = lambda t: {tuple(w[i : i + 5]) for w in [words_of(t, True)] for i in range(len(w) - 4)}
    item = cut(" ".join(f"q{i}" for i in range(20)))
    assert rows(stages["decontaminate"](spark, docs, folder)) == [r for r in before if 100 * len(cut(r[1]) & item) < 80 * len(item)]
    reference = tokenizers.Tokenizer.from_file(vocabulary())
    for r in stages["tokens"](spark, docs, folder).collect():
        assert r["n_tokens"] == len(r["token_ids"]) and r["text"] == reference.decode(r["token_ids"], skip_special_tokens=False)


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "token_ids", "text"]
    assert 0 < out.count() < spark.read.parquet(f"{folder}/documents.parquet").count()


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark, folder):
    rnd = random.Random(4)
    some = lambda: " ".join(f"z{rnd.randrange(900)}" for _ in range(60))
    item, a, b, c = " ".join(f"q{i}" for i in range(20)), some(), some(), some()
    docs = [(None, a, "en", "s", 1), (None, b, "en", "s", 2), (None, b, "en", "s", 2), (None, f"{c} {item}", "en", "s", 3), (5, c, "en", "s", 4), (5, a + " more", "en", "s", 5), (6, f"vile {c} vile2", "en", "s", 6), (6, b + " tail", "en", "s", 7), (7, None, "en", "s", None), (7, "", "en", "s", 0)]
    held = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert rows(stages["near_duplicates"](spark, held, folder)) == sorted((docs[i] for i in (3, 4, 5, 7, 8, 9)), key=str)
    assert rows(stages["decontaminate"](spark, held, folder)) == sorted(docs[:3] + docs[4:], key=str)
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    bad = whole.where("text like '%vile%'").selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")
    kept = rows(stages["quality"](spark, whole.union(bad), folder))
    assert not any("vile" in (r[1] or "") for r in kept) and any(r[0] is None for r in kept)
