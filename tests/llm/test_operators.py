"""Operators against brute force, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from feedforge.llm import bpe, common, fingerprints, licenses, lines, neardup, oracles, packing, quality, repeats, shingles, suffix, tokenfile, tokens, toxicity
from feedforge.llm import queries as registered
from feedforge.llm.graph import components
from tests.compare import database, same
from tests.llm.conftest import SMALL, odd_rows

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [(r[0], r[1]) for r in odd_rows()]


def frame(df):
    return df.toPandas()


# --- shared parts


def word_sets(text, width=5):
    w = text.encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    want = roots({x for p in pairs for x in p}, pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_stop_once_links_are_stars(spark):
    """Each round leaves shuffle files of all its tasks, so that none may only find that nothing has changed."""
    stars = [(9, 1), (1, 8), (7, 1), (12, 11), (11, 12), (5, 5)]
    want = {1: 1, 7: 1, 8: 1, 9: 1, 11: 11, 12: 11}
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(stars, "a long, b long"), rounds=1).collect()} == want
    # a node with two smaller ones, and one between a smaller and a greater one, are no stars yet
    for more in ((9, 2), (13, 12)):
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*stars, more], "a long, b long")).collect()}
        assert got == want | {more[0]: want.get(more[0], 11), **({2: 1} if more[1] == 2 else {})}


def test_shingle_sets(monkeypatch):
    rng = random.Random(2)
    texts = ["", "a", "a b c d", "a b c d e", " \t x\n"] + [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    sets = shingles.shingle_sets([t.encode() for t in texts])
    monkeypatch.setattr(shingles, "BLOCK", 16)
    cut = shingles.shingle_sets([t.encode() for t in texts])
    for t, s, c in zip(texts, sets, cut, strict=True):
        assert len(s) == len(word_sets(t)) and (s == c).all()
    for i in range(len(texts)):
        for k in range(i):
            assert shingles.jaccard_counts(sets[i], sets[k])[0] == len(word_sets(texts[i]) & word_sets(texts[k]))


def test_names_recurse(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(suffix, "SHORT", 2)
    for _ in range(60):
        text = np.tile(rng.integers(0, rng.choice([2, 40, 5000]), rng.integers(2, 400)), rng.integers(1, 4)).astype(np.int32)
        raw = text.tolist()
        assert suffix.suffix_array(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


@pytest.mark.parametrize("short", [1, 4096])
def test_suffix_arrays_and_prefixes(short, monkeypatch):
    monkeypatch.setattr(suffix, "SHORT", short)
    rng = random.Random(3)
    for _ in range(300):
        letters = rng.choice([b"ab", b"abc", b"a", bytes(range(256))])
        b = bytes(rng.choice(letters) for _ in range(rng.randint(1, 50))) * rng.choice([1, 1, 3])
        text = np.frombuffer(b, np.uint8)
        order = suffix.suffix_array(text)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        for need in (5, 1000):
            shared = suffix.permuted_common_prefixes(text, order, need)
            for x, y in zip(order[1:], order[:-1], strict=True):
                n = next((i for i, (p, q) in enumerate(zip(b[x:], b[y:], strict=False)) if p != q), min(len(b) - x, len(b) - y))
                assert shared[x] == n or (n >= need and shared[x] >= need)


# --- operator 1


def brute_classes(texts, percent):
    sets = {i: word_sets(t) for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, roots(sets, pairs)


@pytest.mark.parametrize("block", [500_000, 500])
def test_near_dedup(spark, documents, texts, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    extra = {}
    for k in range(40):  # near copies of one text, some linked only through others
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 4)):
            words[at] = f"n{k}x{at}"
        extra[10_000 + k] = " ".join(words)
    every = texts | extra
    sets, want = brute_classes(every, 85)
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    got = frame(neardup.classes(df, percent=85))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.itertuples()} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_near_dedup_odd(odd, none):
    got = frame(neardup.classes(odd))
    by = {int(r.doc_id): r.component_id for r in got.itertuples() if r.doc_id == r.doc_id}
    assert len(got) == len(ODD) and by[4] == 3 and by[6] == by[7] == by[8] == 5 and by[1] == 1 and by[2] == 2
    kept = neardup.dedup_near(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3, 5, 9, 10, 11, 12]
    assert kept.filter("doc_id is null").count() == 2
    assert neardup.classes(none).count() == 0 and neardup.dedup_near(none).count() == 0


def test_near_dedup_where_one_id_has_several_texts(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(5, a), (5, b), (5, b), (6, a), (7, b + " more"), (5, c), (3, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.component_id) for r in neardup.classes(df).collect())
    assert got == {(5, 5): 3, (6, 5): 1, (7, 5): 1, (5, 3): 1, (3, 3): 1}
    assert sorted((r.doc_id, r.text) for r in neardup.dedup_near(df).collect()) == sorted([(5, a), (5, b), (3, c)])


def test_bands_miss_few_pairs():
    assert neardup.bands(85) == 16
    for percent in (50, 80, 85, 95, 100):
        assert (1 - min(percent / 100, 0.99) ** neardup.ROWS) ** neardup.bands(percent) <= neardup.MISS


def test_sketches_merge():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)) for _ in range(2))
    ra, rb, both = neardup.registers([a, b, np.union1d(a, b)], 64)
    assert (neardup.merge(ra, rb) == both).all()


# --- operator 2


def test_fingerprints(documents, texts):
    got = frame(fingerprints.fingerprint_edits(documents)).sort_values("doc_id")
    ids = list(texts)
    for k, r in enumerate(got.itertuples()):
        text = texts[ids[k]]
        other = fingerprints.edited(text, texts[ids[(k + 1) % len(ids)]])
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (ids[k], len(text), hashlib.sha256(other.encode()).hexdigest())
        a, b = (np.frombuffer(bytes.fromhex(x), "<u2") for x in (r.fingerprint, r.edited_fingerprint))
        assert r.near_edited == (a == b).mean()
        s, t = word_sets(text), word_sets(other)
        true = len(s & t) / len(s | t) if s | t else 1.0
        assert abs(true - r.near_edited) < 0.3
    assert got.groupby([texts[i] for i in got.doc_id]).fingerprint.nunique().max() == 1


def plain_fingerprints(texts):
    """64 minima of (a x + b) mod 2 ** 64 over shingle hashes, their mixed high 16 bits in hex, in plain Python."""
    rng, whole = np.random.Generator(np.random.PCG64(fingerprints.SEED)), (1 << 64) - 1
    a = [2 * int(x) + 1 for x in rng.integers(1, 1 << 63, 64, np.uint64)]
    b = [int(x) for x in rng.integers(0, 1 << 63, 64, np.uint64)]

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & whole
        h = (h ^ h >> 27) * 0x94D049BB133111EB & whole
        return h ^ h >> 31

    out = []
    for t in texts:
        values = [int(x) for x in shingles.shingle_sets([t.encode()])[0]]
        low = [min(((m * x + n) & whole for x in values), default=whole) for m, n in zip(a, b, strict=True)]
        out.append(b"".join((mixed(x) >> 48).to_bytes(2, "little") for x in low).hex())
    return out


def test_fingerprints_equal_plain_ones(spark, texts):
    some = [t for _, t in sorted(texts.items()) if len(t) < 1500][:40] + ["", "one two"]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = sorted(fingerprints.fingerprint_edits(df).collect(), key=lambda r: r.doc_id)
    changed = [fingerprints.edited(t, some[(i + 1) % len(some)]) for i, t in enumerate(some)]
    plain, other = plain_fingerprints(some), plain_fingerprints(changed)
    assert [r.fingerprint for r in got] == plain and [r.edited_fingerprint for r in got] == other
    share = lambda x, y: sum(x[k : k + 4] == y[k : k + 4] for k in range(0, 256, 4)) / 64
    assert [r.near_next for r in got] == [share(x, plain[(i + 1) % len(plain)]) for i, x in enumerate(plain)]
    assert [r.near_edited for r in got] == [share(x, y) for x, y in zip(plain, other, strict=True)]


def test_fingerprint_classes(documents, texts):
    got = frame(fingerprints.near_classes(documents, percent=85))
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == brute_classes(texts, 85)[1]


def test_fingerprint_documents(spark, documents, texts):
    """The classes come from the fingerprints returned, and the other columns are those of the edits."""
    words = [f"w{i}" for i in range(120)]
    chain = {10_000 + k: " ".join([f"n{i}" for i in range(3 * k)] + words[3 * k :]) for k in range(12)}
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(list(chain.items()), "doc_id long, text string"))
    got = fingerprints.fingerprint_documents(df)
    sets, want = brute_classes(texts | chain, 85)
    rows = got.collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in rows} == {i: (want[i], len(sets[i]), want[i] == i) for i in sets} and len(rows) == len(sets)
    plain = fingerprints.fingerprint_edits(df)
    assert sorted(tuple(r) for r in got.select(plain.columns).collect()) == sorted(tuple(r) for r in plain.collect())
    with pytest.raises(ValueError):
        fingerprints.fingerprint_documents(df, percent=70)


def test_fingerprints_odd(odd, none, spark):
    """Every row of the odd table against plain Python; of rows with one id, the order is that of their hashes."""
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64("text"))
    rows = [(r.doc_id, r.text or "") for r in odd.orderBy(order).collect()]
    edits = [fingerprints.edited(t, rows[(i + 1) % len(rows)][1]) for i, (_, t) in enumerate(rows)]
    # rows that are equal in the order may follow each other either way
    want = sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for (i, t), e in zip(rows, edits, strict=True)), key=str)
    got = fingerprints.fingerprint_documents(odd).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == want
    prints = dict(zip([t for _, t in rows], plain_fingerprints([t for _, t in rows]), strict=True))
    assert collections.Counter(r.fingerprint for r in got) == collections.Counter(prints[t] for _, t in rows)
    assert all(r.component_id == r.doc_id and r.kept for r in got if r.n_shingles == 0)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert fingerprints.fingerprint_edits(none).count() == 0 and fingerprints.fingerprint_documents(none).count() == 0
    one = frame(fingerprints.fingerprint_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")))
    assert one.edited_sha256[0] == hashlib.sha256(b"abcdefab").hexdigest()


# --- operators 3 and 10 against SQL, operator 9 against plain Python


@pytest.mark.parametrize("name", ["op3_license_scan", "op10_quality_rules"])
def test_sql(spark, name):
    found = registered.queries()[name](spark, SMALL).toPandas()
    same(found, database(SMALL).sql(oracles.oracle_sql()[name]).df())


def test_licenses_odd(odd, none, spark):
    got = frame(licenses.scan_licenses(odd))
    assert len(got) == len(ODD) and (got.score.between(0, 1)).all()
    assert licenses.scan_licenses(none).count() == 0
    rows = [(1, "CC-BY cc by. All Rights, Reserved"), (2, "Licensed under the new Apache License, Version 2.0"), (3, "cc BYK by")]
    found = {r.doc_id: r for r in frame(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))).itertuples()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels) == (3, 0, 4, "cc-by,reserved")
    assert found[2].base_labels == "" and found[2].labels == "apache-2.0" and 0.7 < found[2].score < 1
    assert found[3].n_base == 0


def test_licenses_count_places_once_and_in_order(spark):
    rows = [
        (1, "creative commons creative commons", "", 0.0),
        (2, "mit license mit license mit license", "", 0.0),
        (3, "licensed under licensed under licensed under licensed under", "", 0.0),
        (4, "commons attribution creative commons", "", 0.0),
        (5, "x released under the mit license released under the mit license", "mit", 1.0),
        (6, "released under the terms of the mit license", "mit", 1.0),
        (7, "permission is hereby granted free of charge to any person who gets a copy of this software and associated documentation files", "mit", None),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(df).collect()}
    assert {i: labels for i, (labels, _) in got.items()} == {i: labels for i, _, labels, _ in rows}
    assert all(abs(got[i][1] - score) < 1e-9 for i, _, _, score in rows if score is not None)


def brute_lines(rows, sites=10):
    """doc_id -> text without the lines that `sites` sites and as many documents show, near copies counting as one document."""
    lines_of = {i: [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for i, t, _ in rows}
    site = {i: s or "" for i, _, s in rows}
    shown = collections.defaultdict(set)
    for i, xs in lines_of.items():
        for x in xs:
            if x:
                shown[x].add(i)
    spread = {x: ids for x, ids in shown.items() if len({site[i] for i in ids}) >= sites}
    asked = set().union(*spread.values()) if spread else set()
    _, kind = brute_classes({i: t or "" for i, t, _ in rows if i in asked}, 80)
    gone = {x for x, ids in spread.items() if len({kind[i] for i in ids}) >= sites}
    return lines_of, gone


def test_lines_against_brute_force(spark, documents):
    rng = random.Random(10)
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    for k in range(120):
        body = [" ".join(word() for _ in range(8)) for _ in range(6)]
        body.insert(rng.randrange(6), f"menu {k % 9}")
        body.append(f"footer {k % 4}")
        rows.append((100_000 + k, "\n".join(body), f"s{rng.randrange(30)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    cut, gone = brute_lines(rows)
    assert {f"footer {k}" for k in range(4)} <= gone
    for i, text, _ in rows:
        kept = [raw for raw, x in zip((text or "").split("\n"), cut[i], strict=True) if x not in gone]
        assert (got[i] or "") == "\n".join(kept)


@pytest.mark.parametrize("copied", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_copies_on_a_common_site_take_no_spread(spark, copied, seed):
    """14 documents on 14 sites show a footer; a copy of each on one site more changes nothing."""
    rng = random.Random(seed)
    own = ["\n".join(" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(9)) for _ in range(5)) for _ in range(14)]
    rows = [(i, f"{t}\nfooter", f"{seed} site {i}") for i, t in enumerate(own)]
    rows += [(100 + i, t, "common") for i, t, _ in rows] if copied else []
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: own[i % 100] for i, _, _ in rows}


def test_lines_exact_near_the_limit(spark):
    rows, at = [], 0
    for sites, name in ((9, "nine"), (10, "ten"), (11, "eleven"), (40, "forty")):
        for s in range(sites):
            rows.append((at, f"own {at}\n{name} sites\nlast {at}", f"s{s}"))
            at += 1
    rows += [(1000 + i, "copy one\ncopy two\ncopy three", f"s{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    for i, text, _ in rows:
        name = text.split("\n")[1].split(" ")[0]
        assert got[i] == (text if name in ("nine", "copy") else f"own {i}\nlast {i}")


def test_lines_footers_and_copies(spark):
    rng = random.Random(9)
    body = lambda n=6: [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(9)) for _ in range(n)]
    footer = ["foot one", "foot two", "foot three"]
    own = [body() for _ in range(24)]
    rows = [(i, "\n".join(b + footer), f"s{i % 12}") for i, b in enumerate(own)]
    # a group of copies with the footer, and one of near copies of 20 lines, both on many sites
    hot, near = body(), body(20)
    rows += [(100 + i, "\n".join(hot + footer), f"s{i % 30}") for i in range(200)]
    edited = [[*near[: i % 20], f"{near[i % 20]} e{i}", *near[i % 20 + 1 :]] for i in range(60)]
    rows += [(400 + i, "\n".join(e), f"s{i % 30}") for i, e in enumerate(edited)]
    # many copies of few documents: 30 sites show the line, in nine documents
    few = [body() for _ in range(9)]
    rows += [(500 + i, "\n".join([*few[i % 9], "few of them"]), f"s{i % 30}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    for i, text, _ in rows:
        assert got[i] == ("\n".join(own[i] if i < 24 else hot) if i < 400 else text)


def test_lines_odd(odd, none):
    got = lines.dedup_lines(odd)
    assert got.columns == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t in ODD)
    assert lines.dedup_lines(none).count() == 0


def test_quality_odd(odd, none, spark):
    got = frame(quality.verdicts(odd))
    assert len(got) == len(ODD) and got[got.n_words < 50].base_failed.all()
    assert quality.filter_quality(odd).columns == odd.columns and quality.filter_quality(none).count() == 0
    text = "a b c a b c d\na\n \na"
    row = frame(quality.measures(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string"))).iloc[0]
    # windows abc, bca, cab, abc, bcd, cda, daa: a b c stands at 0 and 3
    assert (row.n_words, row.word_chars, row.n_dup_lines, row.n_repeat_words) == (9, 9, 1, 6)


def usual(rng, letters, n=80):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(letters + rng.randint(-1, 1))) for _ in range(n)) + "."


def test_quality_fences_follow_their_group(spark):
    rng = random.Random(11)
    # one group's usual words are the other's outliers
    rows = [(k, usual(rng, 4), "en", "short") for k in range(200)] + [(1000 + k, usual(rng, 12), "de", "long") for k in range(200)]
    rows += [(2000, usual(rng, 12), "en", "short"), (2001, usual(rng, 12), "de", "long"), (2002, usual(rng, 4), "de", "long"), (2003, usual(rng, 4), "en", "short")]
    rows += [(3000 + k, rows[0][1], "en", "short") for k in range(600)]  # copies don't narrow the fences
    judged = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [judged[i].kept for i in (2000, 2001, 2002, 2003)] == [False, True, False, True]
    assert judged[0].word_length_high < judged[1000].word_length_low
    assert sum(judged[k].kept for k in range(200)) > 195


def test_quality_judges_twins_apart(spark):
    rng = random.Random(13)
    twin = usual(rng, 12)
    rows = [(k, usual(rng, 4), "en", "a") for k in range(100)] + [(100 + k, usual(rng, 12), "de", "b") for k in range(100)]
    rows += [(500, twin, "en", "a"), (500, twin, "de", "b"), (501, twin, "de", "b"), (501, twin, "de", "b")]
    left = quality.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("doc_id >= 500")
    assert sorted((r.doc_id, r.lang) for r in left.collect()) == [(500, "de"), (501, "de"), (501, "de")]


def text_rows_shuffled(plan):
    """Rows of exchanges that carry a column `text`, in the plan of a query that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return text_rows_shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return text_rows_shuffled(plan.plan())
    children = plan.children()
    below = sum(text_rows_shuffled(children.apply(i)) for i in range(children.size()))
    carries = kind == "ShuffleExchangeExec" and "text#" in plan.output().mkString(",")
    return below + (plan.metrics().apply("shuffleRecordsWritten").value() if carries else 0)


def test_quality_filter_shuffles_only_texts_in_doubt(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(k, usual(rng, 4) if k % 4 else "too short", "en", "a") for k in range(400)] + [(None, usual(rng, 4), None, "a"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {tuple(r)[:4] for r in quality.verdicts(docs).filter("kept").select("doc_id", "text_hash", "lang", "source").collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = quality.filter_quality(docs)
        got = sorted(left.collect(), key=repr)
        assert text_rows_shuffled(left._jdf.queryExecution().executedPlan()) < 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == len(kept) > 250 and {tuple(r) for r in left.selectExpr("doc_id", "xxhash64(text)", "coalesce(lang, '')", "coalesce(source, '')").collect()} == kept
    # where the bitmaps tell nothing, the join does
    monkeypatch.setattr(quality, "flag_members", lambda df, key, keys, name, **_: df.withColumn(name, F.lit(True)))
    assert sorted(quality.filter_quality(docs).collect(), key=repr) == got


# --- operator 4


def test_packing(documents, texts):
    pieces = frame(packing.pack_documents(documents, WORD))
    tok = Tokenizer.from_file(WORD)
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        ids = np.array(tok.encode(texts[i], add_special_tokens=False).ids + [1], "<u4")
        assert b"".join(g.ids) == ids.tobytes() and (g.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(x) == c and len(x) == 4 * n for x, c, n in zip(g.ids, g.ids_crc32, g.length, strict=True))
    assert set(pieces.doc_id) == set(texts)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        n = g.length.sum()
        assert n <= 2048 and n & (n - 1) == 0  # nothing is padded


def test_packing_counts_every_document(spark):
    """The centre and the bounds come from all documents, also beyond 20,000."""
    rng = random.Random(17)
    rows = [(k, rng.choice(("the cat sat", "der Hund lief", "12 %", ""))) for k in range(45_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tok = Tokenizer.from_file(WORD)
    signs = packing.projections(1 << 16)
    ids = {t: np.array(tok.encode(t, add_special_tokens=False).ids + [1]) for t in {t for _, t in rows}}
    total = sum(signs[ids[t]].sum(0) * k for t, k in collections.Counter(t for _, t in rows).items())
    seen, tokens, ranges = [], [], packing.ranges
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "corpus_center", lambda df, f=packing.corpus_center: seen.append(f(df)) or seen[0])
        patch.setattr(packing, "ranges", lambda df, key, *rest: tokens.append(df.agg({"n": "sum"}).first()[0]) or ranges(df, key, *rest))
        pieces = frame(packing.pack_documents(docs, WORD, digest=True))
    n = sum(len(ids[t]) for _, t in rows)
    assert pieces.length.sum() == n and tokens == [n] and np.array_equal(seen[0], total.astype(np.float64) / n)


def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3).astype(np.uint64)
    keys = packing.hilbert(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)].astype(int)
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing_odd(odd, none):
    got = frame(packing.pack_documents(odd, WORD))
    tok = Tokenizer.from_file(WORD)
    assert got.length.sum() == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert packing.pack_documents(none, WORD).count() == 0


def test_neighbours_on_the_curve_are_alike_at_every_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    pieces = frame(packing.pack_documents(docs, WORD, digest=True)).sort_values(["sequence_id", "offset"])
    ids, sizes = pieces.doc_id.tolist(), pieces.doc_tokens.tolist()
    share = collections.Counter(lang.values())
    chance = sum((n / len(lang)) ** 2 for n in share.values())
    for lo, hi in ((50, 200), (200, 600), (600, 1 << 30)):
        pairs = [(a, b) for a, b, n in zip(ids[:-1], ids[1:], sizes[:-1], strict=True) if a != b and lo <= n < hi]
        assert sum(lang[a] == lang[b] for a, b in pairs) / len(pairs) > chance + 0.15


# --- operators 5 and 8

POOL = " \n\t\x00\x0b\x1c\x85   aabcdefXYZ019²½ñéß漢😀'’.,;:!\"#$%é<|endoftext|>×÷ﬁſİK"


def random_texts(n=1500):
    rng = random.Random(6)
    mixed = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    plain = [" ".join("".join(rng.choice("abcXYZéßñ×.,'-01“Ω") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return mixed + plain + [t or "" for _, t in ODD] + ["<|endoftext|>", "a<|endoftext|>b", "don't I'll we've", "a" * 500, " a", "a ", "\na", "a\n"]


def test_library_encoders_equal_the_library():
    for path, kind in ((BYTE, "byte"), (WORD, "word")):
        tok, xs = Tokenizer.from_file(path), random_texts()
        encode = tokens.library_encoder(path, kind)
        encode.known.most = 2000  # forgets while it goes on
        got = [x for i in range(0, len(xs), 100) for x in encode(xs[i : i + 100])]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [tok.encode(x, add_special_tokens=False).ids for x in xs]


def test_bpe_equals_the_library():
    tok, xs = Tokenizer.from_file(BYTE), random_texts()
    vocabulary, encode = bpe.loaded(BYTE)
    for x, got in zip(xs, encode(xs), strict=True):
        ids = np.frombuffer(got, "<u2").astype(np.int64)
        want = tok.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert vocabulary.decode(ids).decode("utf-8", "replace") == tok.decode(want, skip_special_tokens=False)


def test_bpe_query(documents, texts, odd, none):
    tok = Tokenizer.from_file(BYTE)
    for df, want in ((documents, texts.items()), (odd, ((i, t or "") for i, t in ODD))):
        rows = collections.Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in frame(bpe.encode_decode(df, BYTE, digest=True)).itertuples())
        made = collections.Counter()
        for _, t in want:
            ids = tok.encode(t, add_special_tokens=False).ids
            made[len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert rows == made
    assert bpe.encode_decode(none, BYTE).count() == 0


def test_segments_give_any_id():
    rng = np.random.default_rng(7)
    docs = [rng.choice([3, 200, 256, 65535, 65536, 1 << 30], n).astype(np.uint32) for n in (0, 5, 3000, 1)]
    seg = tokenfile.Segment(tokenfile.pack([4, None, 6, 7], docs))
    flat = np.concatenate(docs)
    assert (seg.ids() == flat).all() and len(seg) == len(flat)
    assert [seg.at(i) for i in range(len(flat))] == flat.tolist()
    assert seg.doc_ids == [4, None, 6, 7]
    for _ in range(300):
        lo, hi = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert (seg.ids(lo, hi) == flat[lo:hi]).all()
    least = tokenfile.Segment(tokenfile.pack([-(1 << 63), None], docs[:2]))
    assert least.doc_ids == [-(1 << 63), None]


def test_token_files(spark, documents, texts, odd, none, tmp_path):
    tok = Tokenizer.from_file(BYTE)
    tokenfile.write_ids(documents, str(tmp_path / "a"), BYTE, segment_ids=500)
    got = frame(tokenfile.read_ids(spark, str(tmp_path / "a"))).sort_values("start")
    start = 0
    for (i, t), r in zip(texts.items(), got.itertuples(), strict=True):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids.tobytes())
        start += len(ids)
        if i % 37 == 0:
            k = len(ids) // 2
            assert tokenfile.id_at(spark, str(tmp_path / "a"), i, k) == ids[k]
    with pytest.raises(KeyError):
        tokenfile.id_at(spark, str(tmp_path / "a"), 10**12, 0)
    tokenfile.write_ids(odd, str(tmp_path / "b"), BYTE)
    assert tokenfile.read_ids(spark, str(tmp_path / "b"), digest=True).count() == len(ODD)
    tokenfile.write_ids(none, str(tmp_path / "c"), BYTE)
    assert tokenfile.read_ids(spark, str(tmp_path / "c")).count() == 0


# --- operator 6


def test_toxicity_holds_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = frame(toxicity.score(docs, toxicity.train(docs, labels)))
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    known = duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").df().merge(got, on="doc_id")
    held = known[known.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95 and held[held.predicted == 1].toxic.mean() > 0.9
    assert held[held.toxic == 1].predicted.mean() > 0.7


def plain_ftrl(rows, labels):
    """FTRL-proximal on dicts: feature -> weight."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        pull = max(abs(z[i]) - (toxicity.L1 if i else 0.0), 0.0)
        return -math.copysign(pull, z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2) if pull else 0.0

    for _ in range(toxicity.PASSES):
        for row, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in row}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            g *= toxicity.WEIGHT if y else 1.0
            for i in row:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_toxicity_equals_plain_ftrl(spark):
    rng = random.Random(14)
    bad = ["vile", "awful", "trash"]
    rows = [(i, " ".join(rng.choice([f"w{rng.randrange(60)}", *(bad if i % 3 == 0 else [])]) for _ in range(25)), int(i % 3 == 0)) for i in range(160)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[1][:2]] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = dict(toxicity.train(docs, labels))
    turn = {r.doc_id: r.t for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as t").collect()}
    used = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2), key=lambda r: turn[r[0]])
    want = plain_ftrl([[int(x) for x in f] for f in toxicity.features([t for _, t, _ in used])], [y for *_, y in used])
    assert len(want) > 3 and got.keys() == want.keys() and all(abs(got[i] - w) < 1e-9 for i, w in want.items())
    scores = {r.doc_id: r.score for r in toxicity.score(docs, list(got.items())).collect()}
    for i, t, _ in rows:
        total = sum(want.get(int(f), 0.0) for f in toxicity.features([t])[0])
        assert abs(scores[i] - 1 / (1 + math.exp(-total))) < 1e-9


def test_toxicity_bound_holds_where_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    docs = spark.createDataFrame([(1 + i % 5, f"text number {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    rows = toxicity.examples(docs, labels, sample=20)
    seen = rows.count()
    assert seen == 20


def test_toxicity_odd(odd, none, spark):
    labels = spark.createDataFrame([(5, 1), (9, 0), (None, 1), (3, None), (404, 1)], "doc_id long, toxic int")
    got = frame(toxicity.score(odd, toxicity.train(odd, labels)))
    assert len(got) == len(ODD) and got.score.between(0, 1).all()
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert (frame(toxicity.score(odd, toxicity.train(odd, labels.limit(0)))).score == 0).all()


# --- operator 7


def brute_repeats(rows, length=200):
    raw = [t.encode() for t in rows]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def planted():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(80))
    rows = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(40)]
    rows[:12] = [f"{r[:50]} {passage[k:]} {r[50:]}" for k, r in enumerate(rows[:12])]
    return rows + ["ab" * 400, "z" * 450, passage, passage, "short", "", "x" * 199]


@pytest.mark.parametrize(("wide", "shard", "part"), [(8_000, 1 << 20, 1 << 20), (2, 1 << 20, 1 << 20), (8_000, 1000, 300)])
def test_repeats(spark, wide, shard, part, monkeypatch):
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats.repeats, "__defaults__", (200, shard, wide))
    rows = planted()
    got = frame(repeats.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), digest=True)).sort_values("doc_id")
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()] == brute_repeats(rows)


def test_crowded_anchors_are_dealt_by_longer_ones(spark, monkeypatch):
    """A passage in many contexts, and one that is longer than a window, down to whole windows."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    short, long = text(40)[:150], text(90)
    rows = [f"{text(60)} {short if k % 2 else long} {text(60)}" for k in range(40)]
    rows += [rows[1][:300], rows[0]]
    grams, cut = set(), repeats._sliced
    monkeypatch.setattr(repeats, "_sliced", lambda df, length, gram: grams.add(gram) or cut(df, length, gram))
    monkeypatch.setattr(repeats.repeats, "__defaults__", (200, 1 << 20, 3))
    got = frame(repeats.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), digest=True)).sort_values("doc_id")
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()] == brute_repeats(rows)
    assert grams == {32, 116, 158, 179, 200}


def test_slices_of_crowded_anchors_are_told_apart_without_marking_all_slices(spark, monkeypatch):
    """Only documents pass through bitmaps: marking slices for a few crowded anchors made two more rows for each slice."""
    marked, flag = [], repeats.flag_members
    monkeypatch.setattr(repeats, "flag_members", lambda df, *a, **b: marked.append(set(df.columns)) or flag(df, *a, **b))
    monkeypatch.setattr(repeats.repeats, "__defaults__", (200, 1 << 20, 2))
    rows = planted()
    got = frame(repeats.remove_repeats(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), digest=True)).sort_values("doc_id")
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()] == brute_repeats(rows)
    assert marked and all("text" in c and "slice" not in c for c in marked)


def test_only_slices_that_may_share_a_window_are_sorted():
    rng = random.Random(23)
    some = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    phrase, passage = some(110), some(230)
    # a phrase shorter than a window, a passage longer than one, and cuts of it at both ends of texts
    texts = [some(300) + phrase + some(300) for _ in range(20)] + [some(150) + passage + some(150), some(90) + passage, passage + some(80), passage[:205] + some(60), some(60) + passage[-201:]]
    slices, seen = {}, collections.Counter()
    for t in texts:
        anchor, cut, first, span, _ = repeats._cut(t, np.array([len(t)]), 200)
        seen.update(anchor.tolist())
        for a, c, f, x in zip(anchor.view(np.int64).tolist(), cut.tolist(), first.tolist(), span.tolist(), strict=True):
            data = t[f : f + (x & (1 << repeats.SPAN) - 1) + 199]
            slices[a, c] = (slices.get((a, c), (0,))[0] + 1, x >> repeats.SPAN, data)
    rows = [(a, *r) for (a, _), r in sorted(slices.items()) if seen[a % (1 << 64)] > 1]
    anchors, counts, places, data = (list(x) for x in zip(*rows, strict=True))
    kept = repeats.may_repeat(anchors, counts, places, data, 200, repeats.GRAM)
    windows = collections.Counter(d[k : k + 200] for n, d in zip(counts, data, strict=True) for k in range(len(d) - 199) for _ in range(n))
    shares = np.array([any(windows[d[k : k + 200]] > 1 for k in range(len(d) - 199)) for d in data])
    assert shares.any() and kept[shares].all() and (~kept).sum() > 10
    owner, lo, hi = repeats._runs([np.array(x, bool) for x in ([1, 1, 0, 1], [1], [0, 0], [0, 1])])
    assert list(zip(owner.tolist(), lo.tolist(), hi.tolist(), strict=True)) == [(0, 0, 1), (0, 3, 3), (1, 0, 0), (3, 1, 1)]


def test_repeats_odd(odd, none):
    got = frame(repeats.remove_repeats(odd, digest=True))
    want = brute_repeats([t or "" for _, t in ODD])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()) == sorted(want)
    left = repeats.dedup_repeats(odd)
    assert left.columns == odd.columns and left.filter("doc_id = 5").first()["text"] == "" and left.filter("doc_id = 3").first()["text"] == "Solo"
    assert repeats.remove_repeats(none).count() == 0 and repeats.dedup_repeats(none).count() == 0


# --- what all operators leave alone


def test_session_settings_stay(spark, documents, tmp_path):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    for name in ("op2_fingerprints", "op5_bpe_codec", "op8_token_files"):
        registered.queries()[name](spark, SMALL)
    repeats.dedup_repeats(documents.limit(5))
    assert [spark.conf.get(k) for k in keys] == before


def test_columns_named_like_helpers(spark):
    rows = [(1, "x " * 300, 1, b"a", "i", "h"), (2, "x " * 300, 2, b"b", "i", "h"), (3, "short", 3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __bucket int, __bits binary, __id string, __hash string")
    left = repeats.dedup_repeats(df)
    assert left.columns == df.columns and {r.doc_id: r.text.strip() for r in left.collect()} == {1: "", 2: "", 3: "short"}
    assert neardup.dedup_near(df).columns == df.columns and neardup.dedup_near(df).count() == 2


def test_batches_are_cut_by_rows_and_bytes():
    texts = ["a" * 10, None, "b" * 500, "c" * 500, "d", "e" * 2000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["i", "t"])
    parts = [p.column(1).to_pylist() for p in common.slices([batch], 1, rows=3, size=600)]
    assert sum(parts, []) == texts and [len(p) for p in parts] == [3, 2, 1]
    assert list(common.slices([batch.slice(0, 0)], 1)) == []


def test_a_cluster_needs_a_named_folder():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: self
        get = lambda self, key, default: default
        getCheckpointDir = lambda self: None

    with pytest.raises(ValueError):
        common.shared_folder(type("Session", (), {"sparkContext": Context()}))
