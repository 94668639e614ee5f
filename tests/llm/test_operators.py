"""Each operator against a brute-force version, with its edge cases."""

import hashlib
import json
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from arcweave.llm.chat_format import ChatFormatter, escape, unescape
from arcweave.llm.decontaminate import Decontaminator, ItemIndex, near_masks, weighted_jaccard
from arcweave.llm.host_quality import HostQuality, beta_prior
from arcweave.llm.jaccard_join import JaccardJoin
from arcweave.llm.license_scan import LicenseScan
from arcweave.llm.line_dedup import LineDedup
from arcweave.llm.text import Words, shingles, text_bytes
from arcweave.llm.warc import WarcWriter, format_record, gzip_member, parse_record, read_members, read_warc
from arcweave.operators.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def docs_of(spark, rows, clash=()):
    """Documents with extra columns of the given names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in clash)
    full = [(i, t, None, s, None if t is None else len(t), *("x" for _ in clash)) for i, t, s in rows]
    return spark.createDataFrame(full, schema)


def sample_texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "É", "délta", "eps", "zeta.", "eta", "theta", "x"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


# ---- kernels ------------------------------------------------------------


def test_words_and_shingles():
    texts = [None, "", "  ", "One two\tTHREE\n\x0bfour", "é ü", "a b c d e f a b c d", "x" * 700_000 + " y"]
    seen = {}
    for first, end, data, offsets in text_bytes(pa.array(texts)):
        words = Words(data, offsets)
        hashes = words.hashes()
        grams, bounds = shingles(words, hashes, 4)
        for i in range(end - first):
            text = (texts[first + i] or "").translate(LOWER)
            expected = WORD.findall(text)
            spans = [(int(s), int(e)) for s, e in zip(words.start[words.bounds[i] : words.bounds[i + 1]], words.end[words.bounds[i] : words.bounds[i + 1]])]
            assert [bytes(data[s:e]).decode().translate(LOWER) for s, e in spans] == expected
            for w, h in zip(expected, hashes[words.bounds[i] : words.bounds[i + 1]].tolist()):
                assert seen.setdefault(w, h) == h
            size = len(expected) - 3 if len(expected) >= 4 else min(1, len(expected))
            assert bounds[i + 1] - bounds[i] == size
    assert len(set(seen.values())) == len(seen)


# ---- line dedup ---------------------------------------------------------


def test_line_dedup(spark):
    long = "this line has well over forty code points in it"
    rows = [(i, f"{'  ' if i % 2 else ''}{long.upper() if i % 3 else long}\nown {i}", "s") for i in range(6)]
    rows += [(6, None, None), (7, "", "s"), (None, long, "s"), (8, "short\nshort", "s"), (5, f"{long}\n{long}", "s"), (9, "é" * 39 + "\n" + "y" * 40, "s")]
    rows += [(i, "é" * 39, "s") for i in range(20, 26)]
    docs = docs_of(spark, rows, ("row", "kept", "h1", "drops"))
    found = LineDedup(batches=3).apply(docs)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    rank = lambda i: -1 if i is None else i
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(rank(i))
    expected = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and rank(i) < max(holders[key(x)]))]
        expected.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert LineDedup().apply(docs.limit(0)).count() == 0


# ---- Jaccard join -------------------------------------------------------


def brute_components(rows, k, num, den):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    low = defaultdict(list)
    for a, (i, *_) in enumerate(rows):
        if i is not None:
            low[find(a)].append(i)
    return [(i, len(sets[a]), (min(low[find(a)]) if low[find(a)] else None) if sets[a] else i) for a, (i, *_) in enumerate(rows)]


def near_copies(seed, groups, size):
    rng = random.Random(seed)
    rows, number = [], 100
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 90))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((number, " ".join(copy), "s"))
            number += 1
    return rows


def test_jaccard_join(spark):
    rows = near_copies(3, 12, 9)
    rows += [(1, None, "s"), (2, "", "s"), (3, " \n", "s"), (4, "one two", "s"), (5, "ONE  two", "s"), (None, "one two", "s"), (6, "one three", "s")]
    rows += [(7, "a b c d e f g h", "s")] * 2 + [(8, "a b c d e f g h", "s"), (None, "lone text of nobody else here", "s")]
    docs = docs_of(spark, rows, ("id", "cls", "n", "component"))
    for k, num in ((4, 85), (5, 80)):
        found = JaccardJoin(k, num, 100).components(docs)
        got = sorted(((r["id"], r["n"], r["component"]) for r in found.collect()), key=str)
        assert got == sorted(brute_components(rows, k, num, 100), key=str)
    assert JaccardJoin().components(docs.limit(0)).count() == 0


def test_one_document_of_each_group(spark):
    rows = near_copies(4, 5, 6) + [(1, None, "s"), (2, "", "s"), (500, "q w e r t y u", "s"), (500, "q w e r t y u", "s")]
    docs = docs_of(spark, rows)
    kept = JaccardJoin(5, 80, 100).one_per_group(docs)
    assert kept.columns == docs.columns
    expected = sorted({c for _, n, c in brute_components(rows, 5, 80, 100) if n} | {1, 2})
    assert sorted(r["doc_id"] for r in kept.collect()) == expected


# ---- decontamination ----------------------------------------------------


def brute_matches(rows, items, k, least):
    """By the definition: the weighted Jaccard similarity of every item with every window of its length, or the whole of a shorter text."""

    def grams(w):
        return Counter([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)])

    out = set()
    for i, t, _ in rows:
        w = WORD.findall((t or "").lower())
        for item, text in items:
            v = WORD.findall((text or "").lower())
            if not w or not v:
                continue
            want = grams(v)
            for s in range(max(1, len(w) - len(v) + 1)):
                have = grams(w[s : s + len(v)])
                if sum((want & have).values()) >= least * sum((want | have).values()):
                    out.add((i, item))
    return out


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(12, 50)))) for i in range(20)] + [(50, "three short words"), (51, None), (52, " "), (53, "a a a a a a a a a")]
    rows = []
    for i in range(60):
        w = text(rng.randrange(0, 200))
        for _ in range(rng.choice([0, 0, 1, 2])):
            part = dict(items)[rng.randrange(20)].split()
            if rng.random() < 0.5 and len(part) > 30:
                part[0] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in part] if rng.random() < 0.3 else part
        rows.append((i, " ".join(w), "s"))
    rows += [(70, None, "s"), (71, "", "s"), (72, "Three SHORT words", "s"), (73, "not three short words", "s"), (None, items[3][1], "s"), (74, items[4][1], "s"), (74, items[4][1], "s"), (75, "x " + items[-1][1], "s")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, rows, ("matches", "row"))
    expected = brute_matches(rows, items, 5, 0.8)
    for block in (20_000, 7):
        found = Decontaminator(block_items=block).match(docs, table)
        got = {(r["row"]["doc_id"], m["item_id"]) for r in found.collect() for m in r["matches"]}
        assert got == expected and found.count() == len(rows)
    assert Decontaminator().match(docs, table.limit(0)).where("size(matches) > 0").count() == 0
    assert Decontaminator().match(docs.limit(0), table).count() == 0


def test_multi_index_misses_nothing_within_the_radius():
    index = ItemIndex([(i, " ".join(f"t{i}_{j}" for j in range(20))) for i in range(30)], 5, 19)
    rng = np.random.Generator(np.random.PCG64(1))
    for item in range(30):
        for distance in (0, 7, 19):
            mask = sum(1 << int(b) for b in rng.choice(64, distance, replace=False))
            window, found = index.candidates(20, np.array([int(index.prints[item]) ^ mask], np.uint64))
            assert item in found
    assert len(near_masks(4)) == sum(math.comb(16, d) for d in range(5))
    assert weighted_jaccard(np.array([1, 1, 2]), np.array([1, 2, 2])) == 0.5


# ---- quality ------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if counts[x] >= 2 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_host_quality(spark):
    rng = random.Random(2)
    rows = [(i, t, f"h{i % 3}") for i, t in enumerate(sample_texts(2, 40))]
    rows += [(100, None, "h0"), (101, "", None), (102, " ".join(f"w{i} #" for i in range(200)), "bad"), (103, "a b c\na b c\n\na b c", "h1"), (103, "x y", "h1"), (104, "é ü ß", None)]
    rows += [(200 + i, " ".join(f"{rng.randrange(10**6)} %%" for _ in range(80)), "bad") for i in range(30)]
    docs = docs_of(spark, rows, ("host", "n_words", "row"))
    got = HostQuality().verdicts(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r["row"]["doc_id"], *(r[n] for n in names)) for r in got), key=str) == sorted(((i, *brute_measures(t)) for i, t, _ in rows), key=str)
    assert all(not r["kept"] for r in got if r["host"] == "bad") and any(r["base_failed"] is False for r in got if r["host"] == "bad")
    assert len(got) == len(rows)
    assert HostQuality().verdicts(docs.limit(0)).count() == 0
    rng = np.random.Generator(np.random.PCG64(3))
    n = rng.integers(1, 400, 5000)
    x = rng.binomial(n, rng.beta(0.2 * 30, 0.8 * 30, 5000))
    sums = lambda n, x: (len(n), int(n.sum()), float((n * n).sum()), int(x.sum()), float((x * x / n).sum()))
    mean, weight = beta_prior(*sums(n, x))
    assert mean == pytest.approx(0.2, abs=0.01) and weight == pytest.approx(30, rel=0.1)
    assert (beta_prior(*sums(n, rng.binomial(n, 0.2)))[1] or 1e9) > 3000
    assert beta_prior(*sums(n, n * 0)) == (0.0, None) and beta_prior(*sums(n, n)) == (1.0, None)
    assert beta_prior(0, None, None, None, None) == (0.0, None) and beta_prior(1, 10, 100.0, 3, 0.9) == (0.3, None)
    assert beta_prior(*sums(n, n * (np.arange(5000) % 2)))[1] < 0.01


# ---- licenses -----------------------------------------------------------


def test_license_scan(spark):
    templates = [("A", "this code may be used under the terms of license alpha"), ("B", " ".join(f"clause{i}" for i in range(60))), ("A", "short notice of alpha use")]
    partial = [f"clause{i}" for i in range(60)]
    partial[30] = "edited"
    filler = " ".join(f"f{i}" for i in range(150))
    rows = [
        (1, filler + " This CODE may be used, under the terms of license-alpha! " + filler, "s"), (2, filler + " " + " ".join(partial), "s"),
        (3, " ".join(f"clause{i}" for i in range(25)), "s"), (4, None, "s"), (5, "", "s"), (6, "# short notice\n# of alpha use", "s"),
        (6, "# short notice\n# of alpha use", "s"), (None, "short notice of alpha use", "s"), (7, "alpha", "s"),
    ]
    scan = LicenseScan(templates)
    found = scan.scan(docs_of(spark, rows, ("key", "gram", "class", "template", "license")))
    got = {(r["id"], r["license"], round(r["containment"], 3)) for r in found.collect()}
    assert got == {(1, "A", 1.0), (2, "B", round(51 / 56, 3)), (6, "A", 1.0), (None, "A", 1.0)}
    assert scan.scan(docs_of(spark, rows).limit(0)).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    with pytest.raises(ValueError):
        LicenseScan([("x", "too few words")])


# ---- chat ---------------------------------------------------------------


def test_chat_format(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    shared = [("user", "hello \\ <s>[INST] x [/INST]</s>"), ("assistant", "</s>"), ("user", "")]
    for c in range(80):
        turns = shared[: rng.randrange(0, 4)] + [(rng.choice(["user", "assistant"]), f"t{rng.randrange(6)}\n") for _ in range(rng.randrange(1, 4))]
        expected[c] = turns
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(900, 0, None, None), (901, 1, "assistant", "b"), (901, 0, "user", "a"), (901, 1, "assistant", "b"), (None, 0, "user", "n"), (902, None, "user", "u")]
    expected |= {900: [("", "")], 901: [("user", "a"), ("assistant", "b"), ("assistant", "b")], None: [("user", "n")], 902: [("user", "u")]}
    rows += [(1000 + i, 0, "user", "the same") for i in range(50)]
    expected |= {1000 + i: [("user", "the same")] for i in range(50)}
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, nodes string, pack_id string")
    for size in (65_536, 400):
        packs = Scratch(spark, "test").keep(ChatFormatter(size).pack(table), "packs")
        got = {r["conv_id"]: r for r in ChatFormatter.unpack(packs).collect()}
        assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == expected
        for c, r in got.items():
            assert "".join(r["masked"]) == "".join(t for role, t in expected[c] if role == "assistant")
            assert r["formatted_chars"] == sum(len("<s>[INST][/INST]</s>") + len(escape(role)) + len(escape(t)) for role, t in expected[c])
        for p in packs.collect():
            nodes = p["nodes"]
            for i, n in enumerate(nodes):
                above, spans = n["parent"], []
                while above >= 0:
                    assert nodes[above]["start"] < n["start"] < nodes[above]["attend_until"]
                    spans += range(nodes[above]["start"], nodes[above]["end"])
                    above = nodes[above]["parent"]
                assert sorted(spans) == [x for s in n["ancestors"] for x in range(s["start"], s["end"])]
                assert n["position"] == len(spans)
                assert not any(m["parent"] == n["parent"] and p["text"][m["start"] : m["end"]] == p["text"][n["start"] : n["end"]] for m in nodes[:i])
    assert ChatFormatter().pack(table.limit(0)).count() == 0
    for text in ("", "\\", "<s>", "\\<s>", "[INST][/INST]", "<<s>s>", "a\\nb"):
        assert unescape(escape(text)) == text and not any(c in escape(text) for c in ("<s>", "</s>", "[INST]", "[/INST]"))


# ---- WARC ---------------------------------------------------------------


def test_warc(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>{rng.randrange(30)}</p>" * rng.randrange(0, 9)) for i in range(200)]
    rows += [(300 + i, None, "hot page") for i in range(150)] + [(500, "http://x/\r\nevil: 1", None), (None, "u", "lone"), (501, "é", "ü"), (501, "é", "ü")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    contents = []
    for name in ("a", "b"):
        path = f"file://{tmp_path}/{name}"
        manifest = WarcWriter(shards=4, roll_bytes=4000).write(pages, path)
        assert json.load(open(tmp_path / name / "manifest.json")) == manifest
        assert all(f["bytes"] <= 4000 for f in manifest["files"]) and len(manifest["files"]) > 4
        assert not [x for x in os.listdir(tmp_path / name) if x.startswith("_temporary")]
        contents.append({f["name"]: (tmp_path / name / f["name"]).read_bytes() for f in manifest["files"]})
        assert all(hashlib.sha1(contents[-1][f["name"]]).hexdigest() == f["sha1"] for f in manifest["files"])
    assert contents[0] == contents[1]
    newest = {}
    for i, _, t in rows:
        newest[t or ""] = max(newest.get(t or "", -1), -1 if i is None else i)
    got = read_warc(spark, f"file://{tmp_path}/a").collect()
    assert Counter(r["id"] for r in got) == Counter(i for i, *_ in rows)
    responses = Counter()
    for r in got:
        text = dict((i, t or "") for i, _, t in rows)[r["id"]]
        assert r["payload_bytes"] == len(text.encode())
        if r["record_type"] == "response":
            responses[text] += 1
            assert r["payload"] == text.encode() and r["refers_to"] is None and newest[text] in (r["id"], -1)
        else:
            assert r["refers_to"] == newest[text] and r["payload"] is None
    assert set(responses.values()) == {1} and len(responses) == len(newest)
    small = WarcWriter(shards=2, revisit_from=9)
    small.write(pages, f"file://{tmp_path}/c")
    assert read_warc(spark, f"file://{tmp_path}/c").where("record_type = 'revisit' and payload_bytes < 9").count() == 0
    assert WarcWriter(shards=2).write(pages.limit(0), f"file://{tmp_path}/d")["files"] == []
    assert read_warc(spark, f"file://{tmp_path}/d").count() == 0


def test_warc_damage_is_found():
    import io

    record = format_record(7, "http://a/", b"body", "2024-01-01T00:00:00Z", None)
    assert parse_record(record)["payload"] == b"body"
    with pytest.raises(ValueError):
        parse_record(record.replace(b"body", b"bodx"))
    two = gzip_member(record) * 2
    assert list(read_members(io.BytesIO(two), 7)) == [record, record]
    with pytest.raises(ValueError):
        list(read_members(io.BytesIO(two[:-3])))
