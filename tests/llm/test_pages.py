"""Page, vector and transcript operators against brute force, round trips and held-out pages."""

import base64
import hashlib
import io
import random
import uuid
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("xxhash")

from paceline.llm import archives
from paceline.llm.archives import Package, new_archive_folder, read_archives, write_archives
from paceline.llm.content import example_page, extract_content, fit_content, labelled_pages, parse
from paceline.llm.lattice import decode_e8, near_duplicate_frames
from paceline.llm.reputation import judge_pages
from paceline.llm.transcripts import fit_roles, format_transcripts, marker, unmarked


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, text string, n int").repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 6])
def test_archives_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(archives, "PACKAGE_BYTES", 600)
    rows = [(1, "http://a/ü?x=1%0A", "<p>é</p>"), (7, None, "<p>é</p>"), (3, "u\r\nv", None), (2, "", ""), (9, "x", "long " * 5000), (5, "x", "long " * 5000), (5, "x", "long " * 5000), (None, "y", "only"), (None, "y", "<p>é</p>")]
    folder = new_archive_folder(spark)
    got = read_archives(write_archives(pages(spark, rows), folder, least_bytes=least), folder).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    text = lambda v: None if v is None else str(v)
    expected = []
    for i, u, h in rows:
        f = first.get(h or "")
        again = f is not None and i != f
        expected.append((text(i), u or "", len((h or "").encode()), digest(h), "revisit" if again else "response", text(f) if again else None, None if again else (h or "").encode()))
    assert sorted(((r[0], r[1], r[2], r[3], r[4], r[5], None if r[6] is None else bytes(r[6])) for r in got), key=str) == sorted(expected, key=str)
    assert read_archives(write_archives(pages(spark, []), folder), folder).count() == 0


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


def test_package_reader_reads_other_writers_and_wide_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("plain.txt", b"stored", zipfile.ZIP_STORED)
        z.writestr("packed.txt", b"x" * 999, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    p = Package(Bytes(out.getvalue()))
    at, n = p.locate("plain.txt")
    assert out.getvalue()[at : at + n] == b"stored"
    with pytest.raises(ValueError):
        p.locate("packed.txt")
    with pytest.raises(ValueError):
        Package(Bytes(b"no package"))
    # More members than the short end record can count: the directory is found by its ZIP64 records.
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):
            z.writestr(f"{i}", b"%d" % i)
    p = Package(Bytes(many.getvalue()))
    at, n = p.locate("65999")
    assert len(p.members) == 66_000 and many.getvalue()[at : at + n] == b"65999"


def test_rules_and_reputation(spark):
    rows = [(1, "https://a.good.com/x?q#f"), (2, "HTTP://User@WWW.Example.com/en/p"), (3, "http://example.com/en/"), (4, "http://sub.example.com/en"), (5, "http://h.net/es/1"), (6, "no scheme"), (7, None), (8, "x://"), (9, "http://bad.org/1"), (10, "http://other.bad.org/2"), (11, "http://example.com"), (11, "http://example.com"), (None, "http://q.co.uk/a")]
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]
    outcomes = spark.createDataFrame([("http://bad.org/9", 0)] * 60 + [("http://fine.org/9", 1)] * 60 + [("http://mid.org/1", None), (None, 1)], "url string, good int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_pages(pages(spark, [(i, u, None) for i, u in rows]), outcomes, rules).collect()}
    assert (1, "a.good.com", "/x", "com/", "allow") in got
    assert (2, "user@www.example.com", "/en/p", "example.com/en/", "block") in got  # user@www is no subdomain label of www
    assert (3, "example.com", "/en/", "example.com/en/", "block") in got
    assert (4, "sub.example.com", "/en", "com/", "allow") in got
    assert (5, "h.net", "/es/1", "net/es/", "block") in got
    assert {(r[1], r[2], r[3]) for r in got if r[0] in (6, 7, 8)} == {("", "", None)}
    assert (9, "bad.org", "/1", None, "block") in got
    assert (11, "example.com", "", None) in {r[:4] for r in got}
    assert len(got) == 12
    assert judge_pages(pages(spark, []), outcomes.limit(0), rules).count() == 0


def test_labelled_hosts_that_are_suffixes_return_each_page_once(spark):
    outcomes = spark.createDataFrame([("http://co.uk/", 1), ("http://.co.uk/", 0), ("http://a.co.uk/", 1), ("http://b.co.uk/", 0), ("http://x.b.co.uk/", 0)], "url string, good int")
    urls = [(1, "http://co.uk/p"), (2, "http://.co.uk/p"), (3, "http://new.a.co.uk/"), (4, "http://c.co.uk/"), (5, "http://uk/"), (6, "http://y.b.co.uk/")]
    got = judge_pages(pages(spark, [(i, u, None) for i, u in urls]), outcomes, []).collect()
    assert sorted(r["page_id"] for r in got) == [1, 2, 3, 4, 5, 6]
    mean = {r["page_id"]: r["mean"] for r in got}
    assert mean[3] > mean[4] > mean[6]


def test_lattice_points_are_nearest():
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((300, 8)) * 1.3
    found = decode_e8(x) / 2
    near = np.array(np.meshgrid(*[[-1, 0, 1]] * 8)).reshape(8, -1).T
    for v, f in zip(x, found):
        whole = np.rint(v) + near
        whole = whole[whole.sum(1) % 2 == 0]
        half = np.floor(v) + 0.5 + near
        half = half[half.sum(1) % 2 == 0]
        best = min(((whole - v) ** 2).sum(1).min(), ((half - v) ** 2).sum(1).min())
        assert abs(((f - v) ** 2).sum() - best) < 1e-9


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr("paceline.llm.lattice.PART", 16)
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal((40, 24))
    rows = [(f"f{i:03d}", [float(v) for v in base[i % 40] + rnd.standard_normal(24) * rnd.choice([0.02, 0.2, 1.0])]) for i in range(260)]
    rows += [("z0", None), ("z1", []), ("z2", [0.0] * 24), ("z3", [float("nan")] + [1.0] * 23), ("z4", [float("inf")] * 24), ("z5", [None] + [1.0] * 23), rows[3], ("copy", rows[3][1]), (None, rows[5][1]), ("short", [1.0, 2.0]), ("short2", [2.0, 4.0])]
    frames = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "frame_id string, landmarks array<double>, id int, node string").repartition(3)
    got = sorted((tuple(r) for r in near_duplicate_frames(frames, least_cosine=0.95).collect()), key=str)
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    cosine = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.95
    links = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and cosine(rows[i][1], rows[j][1])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *[root[j] for j in links[i]]]) for i in range(len(rows))]
    least = {}
    for i, (n, _) in enumerate(rows):
        if n is not None:
            least[root[i]] = min(least.get(root[i], n), n)
    expected = sorted(((n, len(links[i]), least.get(root[i]), n == least.get(root[i])) for i, (n, _) in enumerate(rows)), key=str)
    found, there = sum(r[1] for r in got), sum(r[1] for r in expected)
    assert found >= 0.97 * there and found <= there
    if found == there:
        assert got == expected
    assert near_duplicate_frames(frames.limit(0)).count() == 0


def test_content_of_held_out_pages(spark):
    model = fit_content(labelled_pages(spark, 300))
    right = wrong = missed = 0
    for i in range(150):
        dom = parse(example_page(random.Random(10_000 + i)))
        chance = model.marginals(dom)
        for j, t in enumerate(dom.text):
            if t is not None:
                a, b = bool(dom.label[j]), bool(chance[j] >= 0.5)
                right, wrong, missed = right + len(t) * (a and b), wrong + len(t) * (b and not a), missed + len(t) * (a and not b)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.8
    rows = [
        (1, "u", '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One\n two<br>three<p>four</article><footer>&copy; x'),
        (2, None, None),
        (3, "u", ""),
        (4, "u", "<body><div class=menu><ul><li>Home</li></ul></div><div class=content><h1>T</h1><p>Body one.</p><p>Body two.</p></div><div class=comments><p>hi</p></div></body>"),
    ]
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in extract_content(pages(spark, [*rows, rows[0]]), model).collect()}
    assert got == {(1, "A & B One two three four", 24), (2, "", 0), (3, "", 0), (4, "T Body one. Body two.", 21)}
    assert extract_content(pages(spark, []), model).count() == 0


def talks(n, seed):
    rnd = random.Random(seed)
    say = lambda a, b: " ".join(rnd.choice(("lap", "hold", "pace", "start", "foot")) for _ in range(rnd.randint(a, b)))
    rows = []
    for c in range(n):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rnd.randint(1, 4)
        for t, r in enumerate(roles):
            rows.append((f"r{seed}-{c}", t, r, {"system": "You are a coach. ", "user": ""}.get(r, "") + (say(2, 8).capitalize() + "?" if r == "user" else "\n".join(say(15, 40).capitalize() + "." for _ in range(rnd.randint(1, 4))))))
    return rows


def test_roles_of_held_out_talks(spark):
    schema = "request_id string, turn long, role string, text string"
    model = fit_roles(spark.createDataFrame(talks(120, 1), schema))
    held = talks(60, 2)
    got = {(r["request_id"], r["turn"]): r for r in format_transcripts(spark.createDataFrame(held, schema).drop("role"), model).collect()}
    assert sum(got[i, t]["roles"] == [r] for i, t, r, _ in held) >= 0.95 * len(held)
    marked = "System: You are a coach.\nUser: How was my start?\nAssistant: Slow off the pad.\nYou lost a tenth.\nHuman: And the finish?\nAI: Fine."
    odd = [("m", 0, marked), ("m", 1, None), (None, 0, "Who?"), (None, None, "x"), ("d", 5, "Same?"), ("d", 5, "Same?")]
    rows = format_transcripts(spark.createDataFrame(odd, "request_id string, turn long, text string"), model).collect()
    assert len(rows) == len(odd)
    one = next(r for r in rows if r["request_id"] == "m" and r["turn"] == 0)
    assert one["roles"] == ["system", "user", "assistant", "user", "assistant"]
    assert one["formatted"] == "<|system|>\nYou are a coach.\n<|end|>\n<|user|>\nHow was my start?\n<|end|>\n<|assistant|>\nSlow off the pad.\nYou lost a tenth.\n<|end|>\n<|user|>\nAnd the finish?\n<|end|>\n<|assistant|>\nFine.\n<|end|>"
    empty = spark.createDataFrame([], schema)
    assert format_transcripts(empty, fit_roles(empty)).count() == 0


def test_blocks_don_t_change_the_best_path(spark, monkeypatch):
    schema = "request_id string, turn long, role string, text string"
    model = fit_roles(spark.createDataFrame(talks(40, 1), schema))
    long = spark.createDataFrame([("one", t, None, f"{'Next?' if t % 2 else 'Push off. ' * 9}") for t in range(40)], schema)
    whole = sorted((r["turn"], r["roles"]) for r in format_transcripts(long, model).collect())
    monkeypatch.setattr("paceline.llm.transcripts.BLOCK_TURNS", 3)
    assert sorted((r["turn"], r["roles"]) for r in format_transcripts(long, model).collect()) == whole


def test_archive_names_are_new(spark):
    assert new_archive_folder(spark) != new_archive_folder(spark)
    assert uuid.uuid4()


def test_only_the_marker_is_taken_off_a_line(spark):
    far = "word " * 20
    lines = [
        ("<|user|> Meet at 10:30", 2, "Meet at 10:30"), ("[USER] see [1] for more", 2, "see [1] for more"), ("<user> a > b", 2, "a > b"), (f"[assistant] {far}a: b > c]", 3, f"{far}a: b > c]"),
        ("<|im_start|>user", 2, ""), ("<|im_start|>system be kind: always", 1, "be kind: always"), ("**Coach:** go *now*", 3, "go *now*"), ("User:*really* fast: 9.1", 2, "*really* fast: 9.1"), ("[user] :) fine", 2, ":) fine"),
        ("<user>**bold** text", 2, "**bold** text"), ("**User**: hi", 2, "hi"), ("### System: a", 1, "a"), ("<|assistant|>: ok > fine", 3, "ok > fine"), ("user name is set", 0, None), ("<|im_start|>users all", 0, None),
    ]
    found = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(lines)], "i int, line string").select("i", "line", marker(F.col("line")).alias("mark")).collect()
    for r in found:
        _, mark, text = lines[r["i"]]
        assert r["mark"] == mark, r["line"]
        assert text is None or unmarked(r["line"], r["mark"]) == text, r["line"]


def test_text_of_formulas_and_players_is_read():
    page = "<article><p>where <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> holds</p><video src=v>no player here</video><svg><title>t</title><text>label</text></svg></article>"
    assert " ".join(t for t in parse(page).text if t is not None) == "where x=1 holds no player here label"


@pytest.mark.parametrize("odd", ["<![ endif]>", "<![1]>", "<![x[ y]]>", "<![if !IE]>", "<![CDATA[ x ]]>", "<![", "<!", "<!x y>"])
def test_odd_declarations_end_no_page(odd):
    dom = parse(f"<html><body><article><p>some words before</p>{odd}<p>and words behind</p></article></body></html>")
    text = " ".join(t for t in dom.text if t)
    assert "some words before" in text and ("and words behind" in text or odd in ("<![", "<!"))
