"""Text operators against brute force on small attempts: nulls, blanks, ties, repeated rows, empty tables, clashing columns."""

import random

import pytest

pytest.importorskip("xxhash")

from paceline.llm.bpe import Remembered, WordBpe, decode_notes, encode_notes, token_texts
from paceline.llm.common import WordHashes
from paceline.llm.importance import features, kth_largest, sample_usable_notes
from paceline.llm.jaccard import allocate, band_edges, most_different, near_duplicate_notes
from paceline.llm.leaks import find_leaked_items
from paceline.llm.passages import remove_repeated_passages

SCHEMA = "attempt_id string, notes string, id long, text string, node string, key int"


def attempts(spark, rows):
    """Attempts with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", "n", 2) for i, t in rows], SCHEMA).repartition(3)


def words_of(text, fold):
    raw = (text or "").encode()
    return [w.decode() for w in (raw.lower() if fold else raw).split()]


def near_rows():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [("a0", None), ("a1", ""), ("a2", " \t\n"), ("a3", "One two"), ("a4", "one TWO"), (None, "one two"), ("a5", "lone"), ("a5", "lone")]
    for g in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice((6, 20, 60, 150, 400)))]
        for c in range(rnd.randint(1, 7)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((f"g{g:02d}-{c}", (" " if c % 2 else "  ").join(own)))
    return rows


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = words_of(t, True)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return sorted(((n, len(sets[i]), least.get(root(i), n)) for i, (n, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    rows = near_rows()
    got = near_duplicate_notes(attempts(spark, rows), shingle_words=size, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, size, percent)


def test_near_duplicates_of_nothing(spark):
    assert near_duplicate_notes(attempts(spark, [])).count() == 0


def test_schemes_cover_the_largest_difference():
    for low, high in band_edges(85, 5000):
        for rows in (10, 10**5, 10**9):
            s = allocate(low, high, rows, 85)
            assert not most_different(high, 85) or s.segments + s.doubled >= most_different(high, 85) + 1 + s.slack


def brute_passages(rows, window):
    texts = [words_of(t, False) for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[tuple(t[i : i + window])] = seen.get(tuple(t[i : i + window]), 0) + 1
    out = []
    for (name, _), t in zip(rows, texts):
        gone = set()
        for i in range(len(t) - window + 1):
            if seen[tuple(t[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((name, len(t), len(gone), " ".join(w for i, w in enumerate(t) if i not in gone)))
    return sorted(out, key=str)


def passage_rows():
    rnd = random.Random(9)
    word = lambda: f"v{rnd.randrange(3000)}"
    passage = [word() for _ in range(30)]
    rows = [("b0", None), ("b1", ""), ("b2", "The " * 60), ("b3", "x y " * 40), ("b4", "short note"), ("b5", " ".join(word() for _ in range(90))), ("b5", "same id, other text"), ("b6", "Upper " + " ".join(passage).upper())]
    rows += [rows[5], (None, " ".join(passage))]
    for i in range(25):
        own = [word() for _ in range(rnd.randrange(0, 60))]
        at = rnd.randrange(len(own) + 1)
        rows.append((f"c{i}", " ".join(own[:at] + passage[: rnd.choice((8, 12, 13, 30))] + own[at:])))
    return rows


@pytest.mark.parametrize("hot", [0, 32_768])
@pytest.mark.parametrize("window", [12, 3])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, hot, window):
    monkeypatch.setattr("paceline.llm.passages.HOT", hot)
    rows = passage_rows()
    got = remove_repeated_passages(attempts(spark, rows), window_words=window)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute_passages(rows, window)


def test_untouched_notes_stay_as_they_are(spark):
    got = remove_repeated_passages(attempts(spark, [("a", "  two  words\n"), ("b", None)]), window_words=5, carry=("key", "text"), keep_untouched=True).collect()
    assert sorted((r["attempt_id"], r["notes"], r["n_removed"], r["key"], r["text"]) for r in got) == [("a", "  two  words\n", 0, 2, "x"), ("b", "", 0, 2, "x")]
    assert remove_repeated_passages(attempts(spark, [])).count() == 0


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: f"u{rnd.randrange(2000)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice((3, 5, 9, 30, 80))))) for i in range(30)] + [(30, None), (31, ""), (2, None)]
    rows = [("d0", None), ("d1", "")]
    for i in range(40):
        own = [word() for _ in range(rnd.choice((5, 200, 3000)))]
        text = (items[rnd.randrange(30)][1] or "").split()
        if text and i % 4:
            for _ in range(i % 3):
                text[rnd.randrange(len(text))] = word()
            own[rnd.randrange(len(own)) :] = [t.upper() for t in text] + [word()]
        rows.append((f"e{i}", " ".join(own)))
    rows.append(rows[-1])
    cut = lambda t: {tuple(w[i : i + 5]) for w in [words_of(t, True)] for i in range(len(w) - 4)}
    expected = sorted((n, k, len(cut(x)), len(cut(x) & cut(t))) for n, t in rows for k, x in set(items) if cut(x) and 100 * len(cut(x) & cut(t)) >= 80 * len(cut(x)))
    held = spark.createDataFrame(items, "case_id long, evidence string")
    assert sorted(tuple(r) for r in find_leaked_items(attempts(spark, rows), held).collect()) == expected
    assert len(expected) > 10
    assert find_leaked_items(attempts(spark, []), held).count() == 0
    assert find_leaked_items(attempts(spark, rows), held.limit(0)).count() == 0


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_encoding_equals_the_library_and_decodes(spark):
    reference = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary())
    rnd = random.Random(1)
    letters = "abcdefgh'sSΣσςİéÉ ß\t\n\x85\xa00123½!?<|>日本語🙂👍🏽́ñ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += ["a" * 3000, "aaab" * 200, "<|endoftext|>hi<|startoftext|> x", "!" * 500, "I'm you've 'S"]
    rows = [(f"t{i}", t) for i, t in enumerate(texts)] + [("n", None), (None, "hello"), ("t0", texts[0])]
    path = vocabulary()
    got = decode_notes(encode_notes(attempts(spark, rows), path), path).collect()
    expected = [(n, reference.encode(t or "", add_special_tokens=False).ids) for n, t in rows]
    assert sorted(((r["attempt_id"], r["token_ids"], r["n_tokens"], r["notes"]) for r in got), key=str) == sorted(((n, ids, len(ids), reference.decode(ids, skip_special_tokens=False)) for n, ids in expected), key=str)
    assert encode_notes(attempts(spark, []), path).count() == 0


def test_every_prefix_has_one_last_token():
    bpe = WordBpe(vocabulary())
    for word in ("strawberries", "aaaaaaab", "rührei", "xqzt"):
        assert "".join(token_texts(vocabulary())[i] for i in bpe.of_token[word]).count("</w>") == 1


def test_remembered_entries_come_back_whatever_the_limit():
    asked = []
    held = Remembered(lambda w: asked.append(w) or (len(w),), 3)
    rnd = random.Random(1)
    for _ in range(500):
        word = "x" * min(rnd.randrange(1, 9), rnd.randrange(1, 9))
        assert held[word] == (len(word),)
    assert len(held) <= 3 and len(held.older) <= 3 and len(asked) < 400


def test_sampling_keeps_usable_and_drops_the_rest(spark):
    rnd = random.Random(2)
    word = lambda: f"k{rnd.randrange(300)}"
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        own = [word() for _ in range(rnd.randrange(20, 200))]
        if bad:
            for _ in range(3):
                own[rnd.randrange(len(own))] = rnd.choice(("rotten", "rottenest", "awful"))
        rows.append((f"s{i}", " ".join(own)))
        if i % 2 == 0 and i < 900:
            labels.append((f"s{i}", 0 if bad else 1))
    rows += [("null", None), (None, "some words"), rows[1]]
    labels += [("s2", 1), (None, 1), ("s4", None)]
    held = spark.createDataFrame(labels, "attempt_id string, usable int")
    got = {(r["attempt_id"], r["kept"]) for r in sample_usable_notes(attempts(spark, rows), held).collect() if r["attempt_id"]}
    unlabelled = range(900, 1200)
    assert sum((f"s{i}", True) in got for i in unlabelled if i % 6) >= 0.97 * sum(i % 6 > 0 for i in unlabelled)
    assert not any((f"s{i}", True) in got for i in unlabelled if i % 6 == 0)
    assert ("null", True) in got
    again = {(r["attempt_id"], r["kept"]) for r in sample_usable_notes(attempts(spark, rows).repartition(5), held).collect() if r["attempt_id"]}
    assert again == got
    exact = sample_usable_notes(attempts(spark, rows), held, keep=100).where("kept").count()
    assert exact in (100, 101)  # a repeated row shares its fate
    assert sample_usable_notes(attempts(spark, []), held).count() == 0
    assert sample_usable_notes(attempts(spark, rows[:5]), held.limit(0)).where("kept").count() == 5


def test_every_n_gram_has_its_own_count():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))).encode() for _ in range(200_000)]
    text = b" " + b" ".join(words) + b" "
    fives = {text[i : i + 5] for i in range(len(text) - 4) if b" " not in text[i + 1 : i + 4]}
    row, key = features([words, words[:2]], WordHashes())
    assert (row == 0).sum() == len(set(key[row == 0])) == len(set(words)) + len(set(zip(words, words[1:]))) + len(fives)


def test_sampling_knows_pairs_of_words(spark):
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(800):
        own = [f"k{rnd.randrange(200)}" for _ in range(40)]
        own[5:5], own[20:20] = (["cold"], ["call"]) if i % 4 else (["cold", "call"], ["cold", "call"])
        rows.append((f"s{i}", " ".join(own)))
        if i < 500:
            labels.append((f"s{i}", int(i % 4 > 0)))
    got = {r["attempt_id"]: r["kept"] for r in sample_usable_notes(attempts(spark, rows), spark.createDataFrame(labels, "attempt_id string, usable int")).collect()}
    assert sum(got[f"s{i}"] for i in range(500, 800, 4)) <= 0.1 * 75  # the sample's noise may keep one
    assert sum(got[f"s{i}"] for i in range(500, 800) if i % 4) >= 0.95 * 225


def test_kth_largest_is_exact(spark):
    values = [float(x) for x in [5, 5, 5, 1, -3, 7.5, 1e9, 0.25] + list(range(3000))]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 4, 1000, len(values) - 1):
        assert kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]
