"""The corpus operators against plain computations on small tables with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stationcast.llm import (
    catalog,
    chat,
    components,
    factorisation,
    fingerprints,
    html_crf,
    jaccard,
    mixing,
    quality_rules,
    sentencepiece_lattice,
    simhash,
    suffix_dedup,
    text,
    url_filter,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"wort{i % 97}é" for i in range(3000))
PASSAGE = "x" + " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    (1, "The cat sat on the mat. " * 30, "en", "a"),
    (2, "The cat sat on the mat. " * 30, "en", "a"),
    (3, "", "en", "b"),
    (4, None, None, None),
    (5, LONG, "de", "b"),
    (6, "one", "en", "a"),
    (7, f"before {PASSAGE} after", "en", "c"),
    (8, f"{PASSAGE} elsewhere\u00a0é", "en", "c"),
    (8, f"{PASSAGE} elsewhere\u00a0é", "en", "c"),
    (None, "no key at all", "fr", "a"),
    (9, "### $$$ &&& %%% |||\n" * 20, "en", "a"),
    (10, "\n \t\n", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, `key` string, `text2` string, `ids` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "k", "t", "i") for r in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def find_roots(ids, links):
    root = {i: i for i in ids}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def shingles(text, size):
    w = (text or "").encode().split()
    return {b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_block_links_equal_all_distances():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 62, (150, 1)).astype(np.uint64)
    words[1::3] = words[::3] ^ np.uint64(0b101)
    words[2::3] = words[::3] ^ np.uint64(0b1110)
    for radius in (0, 1, 2, 3, 5):
        i, j = simhash.block_links(words, radius)
        want = {(a, b) for a, b in itertools.combinations(range(150), 2) if int(words[a, 0] ^ words[b, 0]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_forest_keeps_components_when_costly_links_go():
    rng = np.random.default_rng(2)
    i, j = np.array(list(itertools.combinations(range(30), 2))).T
    cost = rng.integers(0, 50, len(i))
    kept = simhash.spanning_forest(i, j, cost, 30)
    assert len(kept) == 29
    for most in (3, 10, 50):
        every = find_roots(range(30), [(a, b) for a, b, c in zip(i, j, cost) if c <= most])
        tree = find_roots(range(30), [(i[k], j[k]) for k in kept if cost[k] <= most])
        assert every == tree


def test_simhash_of_awkward_texts(docs, none):
    got = simhash.link_documents(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        texts = [t for k, t, *_ in TEXTS if k == r["doc_id"]]
        words = [w.lower() for w in WORD.findall(texts[0] or "")]
        made = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in made]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r["fp"].hex() == f"{want:016x}"
    roots = {r["doc_id"]: r["component_id"] for r in got}
    assert roots[2] == 1 and roots[4] == 3 and roots[10] == 3 and roots[8] == 8
    assert simhash.link_documents(none).count() == 0


def test_tiles_find_what_one_block_finds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 20, (300, 2))})
    fps = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")
    monkeypatch.setattr(simhash, "TILE", 16)
    links = simhash.near_fingerprints(fps, 2, simhash.pigeonhole_groups(64, 2)).collect()
    got = find_roots(values, [(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in links])
    want = find_roots(values, [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2])
    assert got == want


def near_texts():
    rng = np.random.default_rng(5)
    out = []
    for group in range(8):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for copy in range(3):
            mine = list(words)
            for at in rng.integers(0, 200, copy * 3):
                mine[at] = f"edit{group}{copy}{at}"
            out.append((len(out), " ".join(mine)))
    return out


@pytest.mark.parametrize("method", ["simhash", "minhash"])
def test_near_duplicates_are_verified(spark, method):
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = find_roots(sets, links)
    if method == "simhash":
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}
    else:
        got = {r["doc"]: r["component_id"] for r in fingerprints.near_duplicates(df).collect()}
    assert got == want and links


def texts_around_the_limit():
    """Groups whose texts are now a little above, now a little below 0.8 alike."""
    rng = np.random.default_rng(11)
    out = []
    for group in range(12):
        words = [f"g{group}w{x}" for x in range(124)]
        for copy in range(16):
            mine = list(words)
            for at in rng.integers(0, 124, int(rng.integers(1, 4))):
                mine[at] = f"edit{group}x{copy}x{at}"
            out.append((len(out), " ".join(mine)))
    return out


def linked_by_brute_force(rows):
    sets = {i: shingles(t, 5) for i, t in rows}
    return find_roots(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])


def test_pairs_are_judged_before_the_forest(spark, monkeypatch):
    rows = texts_around_the_limit()
    sets = [np.unique([hash(x) for x in shingles(t, 5)]) for _, t in rows]
    i, j = jaccard.alike(sets, 0.8)
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist())) == want
    table = spark.createDataFrame([(str(k).encode(), x.tolist()) for k, x in enumerate(sets)], "fp binary, set array<bigint>")
    dealt = table.select(F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("bucket"), "fp")
    for tile in (1024, 64):  # one block and many tiles
        monkeypatch.setattr(simhash, "TILE", tile)
        links = [(int(r["a"]), int(r["b"])) for r in simhash.sure_links(dealt, table, 0.8).collect()]
        assert find_roots(range(len(sets)), links) == linked_by_brute_force(rows)


@pytest.mark.parametrize("method", ["simhash", "minhash"])
def test_groups_around_the_limit_are_whole(spark, method):
    rows = texts_around_the_limit()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if method == "simhash":
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}
    else:
        got = {r["doc"]: r["component_id"] for r in fingerprints.near_duplicates(df).collect()}
    assert got == linked_by_brute_force(rows)


def test_no_pair_at_the_limit_is_missed(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_OFTEN", 2)  # orders common members last on small tables
    rng = np.random.default_rng(12)
    rows = []
    for pair in range(400):  # one link each: sets exactly 0.8 alike, whose fingerprints differ more or less
        head = [f"p{pair}w{x}" for x in range(36)] if pair % 2 else [f"common{x}" for x in range(6)] + [f"p{pair}w{x}" for x in range(30)]
        rows += [(2 * pair, " ".join([*head, *(f"a{pair}y{x}" for x in range(4))])), (2 * pair + 1, " ".join([*head, *(f"b{pair}y{x}" for x in range(4))]))]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_one_of_each_group_stays(docs, none):
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    # copies go, and 8, which shares all but the edges with 7; rows without words or key stay
    assert ids == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 1, 9: 1, 10: 1}
    assert simhash.keep_one_per_group(none).count() == 0


def test_rows_are_known_by_key_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a.replace("a39", "z")
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (None, c, "x"), (None, c, "x"), (3, c, "y"), (None, near, "x"), (4, b, "z"), (4, b, "z"), (5, "", "x"), (5, "", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one_per_group(df).collect()), key=str)
    # the unique text b of key 2 stays though another row of key 2 is a copy; copies without a key go
    assert kept == sorted([(1, a), (2, b), (3, c), (5, ""), (5, ""), (None, None)], key=str)
    none = spark.createDataFrame([(None, c), (None, c), (None, c + " more")], "doc_id bigint, text string")
    assert simhash.keep_one_per_group(none).count() == 1


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_constructed_texts_do_not_collide(spark):
    for n in (512, 1024, 2048, 4096):
        for a, b in ("ab", "xy", "09"):
            one, two = thue_morse(n, a, b), thue_morse(n, b, a)
            data, offsets = text.batch_bytes(pa.array([one, two, one]))
            h = text.content_hashes(data, offsets[:-1], offsets[1:])
            assert h[0] != h[1] and h[0] == h[2]
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    stats = quality_rules.batch_statistics(pa.array([f"{one}\n{two}\n{one}", f"{one} x y {two} x y"]))
    assert stats["n_dup_lines"].tolist() == [1, 0] and stats["n_repeat_words"].tolist() == [0, 0]
    prints = fingerprints.fingerprint_documents(spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")).collect()
    assert prints[0]["fingerprint"] != prints[1]["fingerprint"]


def test_content_hashes_follow_the_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3980, 600)
    ends = np.minimum(starts + rng.integers(0, 12, 600), 4000)
    ends[:20] = np.minimum(starts[:20] + 2000, 4000)
    h = text.content_hashes(data, starts, ends)
    known = {}
    for a, b, x in zip(starts, ends, h.tolist()):
        assert known.setdefault(data[a:b].tobytes(), x) == x
    assert len(set(known.values())) == len(known)
    assert len(text.content_hashes(data[:0], starts[:0], ends[:0])) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_rows_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(simhash, "TILE", 16)  # several tiles to a bucket, and places of the second comparison
    rng = np.random.default_rng(seed)
    bases = [[f"w{seed}{g}x{i}" for i in range(60)] for g in range(5)]
    rows = []
    for i in range(160):
        words = list(bases[int(rng.choice([0, 0, 0, 0, 1, 2, 3, 4]))])
        for at in rng.integers(0, 60, int(rng.integers(0, 6))):
            words[at] = f"e{int(rng.integers(0, 400))}"
        rows.append((int(rng.integers(0, 120)) if rng.random() < 0.9 else None, " ".join(words)))
    sets = [shingles(t, 5) for _, t in rows]
    links = [
        (i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    ]
    groups = collections.defaultdict(list)
    for i, root in find_roots(range(len(rows)), links).items():
        groups[root].append(i)
    digest = [hashlib.sha256(t.encode()).digest()[:16] for _, t in rows]
    want = []
    for members in groups.values():
        classes = collections.defaultdict(list)
        for i in members:
            classes[frozenset(sets[i])].append((rows[i][0] is None, rows[i][0] or 0, digest[i], rows[i]))
        want.append(min(min(c) for c in classes.values())[3])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in simhash.keep_one_per_group(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_near_duplicates_go_through_simhash(spark, monkeypatch):
    """The groups of linked fingerprints are judged; sets are made of few texts, though all share a rare shingle."""
    linked, made = [], []
    near, sets = simhash.near_fingerprints, simhash.class_sets

    def links(fps, radius, groups):
        linked.append((fps.count(), radius))
        return near(fps, radius, groups)

    def held(classes, texts, size):
        made.append(classes.count())
        return sets(classes, texts, size)

    monkeypatch.setattr(simhash, "near_fingerprints", links)
    monkeypatch.setattr(simhash, "class_sets", held)
    rng = np.random.default_rng(14)
    rows = [(i, "five words all texts share " + " ".join(f"u{x}" for x in rng.integers(0, 1 << 40, 300))) for i in range(60)]
    rows += [(60 + i, rows[i][1] + " more") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()}
    assert got == {i: i % 60 for i in range(63)}
    assert linked == [(63, simhash.RADIUS)]
    assert sorted(made)[0] <= 6 and sum(made) <= 63 + 6  # those of the sample and of the pairs that are judged


def test_bins_miss_no_alike_sets():
    rng = np.random.default_rng(15)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 900))).astype(np.uint64)
        if rng.random() < 0.3:
            base = base << np.uint64(12)  # one bin holds them all
        sets += [np.unique(base), np.unique(np.append(base[: int(len(base) * rng.uniform(0.3, 1)) + 1], np.uint64(7)))]
    for similarity in (0.2, 0.5, 0.8):
        got = jaccard.maybe_alike(jaccard.bin_counts(sets), np.array([len(x) for x in sets]), similarity)
        i, j = jaccard.alike(sets, similarity)
        assert len(i) and got[i].all() and got[j].all()
        assert similarity < 0.8 or got.sum() < len(sets)


def test_places_of_many_components_cost_their_pairs(spark):
    """Every pair of different components meets, and a bucket of n classes is not compared n times n for each of its tiles."""
    names = [f"{i:03d}".encode() for i in range(400)]
    rows = spark.createDataFrame([(1, x) for x in names] + [(2, x) for x in names[295:310]], "bucket bigint, fp binary")
    major = spark.createDataFrame([(x, names[300]) for x in names[300:]], "node binary, root binary")
    places = collections.defaultdict(set)
    for r in simhash._other_places(rows, major, 16).collect():
        places[r["place"]].add(bytes(r["fp"]))
    met = {p for x in places.values() for p in itertools.combinations(sorted(x), 2)}
    assert all(p in met for p in itertools.combinations(names, 2) if p[0] < names[300])
    assert sum(len(x) ** 2 for x in places.values()) <= 4 * len(names) ** 2
    assert max(map(len, places.values())) < 100


def test_prefixes_follow_the_frequencies_of_a_share(spark, monkeypatch):
    """Alike sets share a member of their prefixes; passages of one text in a hundred are found in the sample of a large table."""
    monkeypatch.setattr(jaccard, "_SAMPLE", 10)
    monkeypatch.setattr(jaccard, "_SHARE", 4)
    rng = np.random.default_rng(16)
    texts = [" ".join(f"u{x}" for x in rng.integers(0, 1 << 40, 12)) + (" a passage that comes again" if i % 20 == 0 else "") for i in range(4000)]
    named = jaccard.named_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text")
    some = jaccard.sampled(named)
    assert 700 < some.count() < 1300
    frequent = jaccard.frequent_members(jaccard.read_sets(some, 5).unionByName(jaccard.read_sets(some, 5)))
    hashes, _ = jaccard.shingles(pa.array(["a passage that comes again"]), 5)
    assert frequent[0].tolist() == hashes.tolist() and 20 < frequent[1][0] < 90
    sets = jaccard.text_sets(pa.array(texts[:200] + [x + " more" for x in texts[:200]]), 5)
    i, j = jaccard.alike(sets, 0.8)
    found = jaccard.set_prefixes(sets, 0.8, frequent)
    assert len(i) >= 190 and all(len(np.intersect1d(found[a], found[b])) for a, b in zip(i, j))
    assert not any(hashes[0] in x for x in found)


def test_blocks_of_buckets_across_batches():
    """Buckets of one row are left out, and those that go on in another batch are whole."""
    rng = np.random.default_rng(17)
    buckets = np.sort(rng.integers(0, 300, 400))
    fps = [int(x).to_bytes(8, "big") for x in rng.permutation(400)]
    seen = []

    def compare(block):
        seen.extend(block)
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    batch = pa.record_batch({"bucket": pa.array(buckets), "fp": pa.array(fps, pa.binary())})
    cuts = [0, 1, 2, 2, 50, 51, 180, 399, 400]
    list(simhash._forest(compare)(batch.slice(a, b - a) for a, b in itertools.pairwise(cuts)))
    times = collections.Counter(buckets.tolist())
    assert sorted(seen) == sorted(fp for x, fp in zip(buckets.tolist(), fps) if times[x] > 1)


def test_fingerprints_of_neighbours(docs, none):
    rows = [r for r in TEXTS]
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    order = sorted({k for k, *_ in rows if k is not None}, reverse=True) + [None]
    text = {k: t or "" for k, t, *_ in rows}
    for r in got:
        own, following = text[r["doc"]], text[order[(order.index(r["doc"]) + 1) % len(order)]]
        k = len(own) // 3
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256((own[: len(own) - k] + following[:k]).encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1
    same = {r["doc"]: r["fingerprint"] for r in got}
    assert same[1] == same[2] != same[7] and same[3] == same[4]
    assert fingerprints.fingerprint_documents(none).count() == 0


@pytest.mark.parametrize("keep_first", [True, False])
def test_repeated_strings(spark, docs, none, keep_first):
    length = 200
    rows = {(k, t or "") for k, t, *_ in TEXTS} | {(20, "ab" * 400), (21, "z" * 1000), (22, "é" * 300)}
    df = spark.createDataFrame(sorted(rows, key=str), "doc_id bigint, text string")
    seen, count = set(), collections.Counter()
    for _, t in rows:
        raw = t.encode()
        count.update(raw[p : p + length] for p in range(len(raw) - length + 1))
    got = {r["doc"]: r for r in suffix_dedup.dedup_report(df, length=length, keep_first=keep_first).collect()}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = t.encode()
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if (s in seen) if keep_first else count[s] > 1:
                cover[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        spans = len(re.findall(b"\1+", bytes(cover)))
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(raw), sum(cover), spans), k
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert suffix_dedup.dedup_report(none).count() == 0


def test_repeats_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TILE", 4)
    shared = PASSAGE[:260]
    rows = [(i, f"{'q%d ' % i * 40}{shared}{' r%d' % i * 40}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc"]: r["n_removed"] for r in suffix_dedup.dedup_report(df, length=200, keep_first=False).collect()}
    assert set(got) == set(range(30)) and min(got.values()) >= 260


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("tile", [2, 4096])
def test_large_anchors_in_parts(spark, monkeypatch, tile, keep_first):
    """Many near copies of a passage, with repeated rows; rows made stay in proportion to them."""
    monkeypatch.setattr(suffix_dedup, "TILE", tile)
    length, rng = 200, np.random.default_rng(16)
    base = "".join(rng.choice(list("abcdefgh"), 700))
    rows = []
    for i in range(24):
        mine = list(base)
        for at in rng.integers(0, 700, int(rng.integers(0, 5))):
            mine[at] = "X"
        rows.append((i, "".join(mine[int(rng.integers(0, 80)) :])))
    seen, count = set(), collections.Counter(t[p : p + length] for _, t in rows for p in range(len(t) - length + 1))
    want = {}
    for i, t in rows:
        cover = bytearray(len(t))
        for p in range(len(t) - length + 1):
            x = t[p : p + length]
            if (x in seen) if keep_first else count[x] > 1:
                cover[p : p + length] = b"\1" * length
        for p in range(len(t) - length + 1):
            if keep_first and t.find(t[p : p + length]) < p:
                cover[p : p + length] = b"\1" * length
            seen.add(t[p : p + length])
        want[i] = sum(cover)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc"]: r["n_removed"] for r in suffix_dedup.dedup_report(df, length=length, keep_first=keep_first).collect()}
    assert got == want


def test_only_anchors_that_occur_again_are_stored(spark, monkeypatch):
    kept = {}
    plain = suffix_dedup.stage
    monkeypatch.setattr(suffix_dedup, "stage", lambda df, name, *a: kept.setdefault(name, plain(df, name, *a)))
    rng = np.random.default_rng(3)
    alone = [(i, "".join(rng.choice(list("abcdefgh "), 2000))) for i in range(20)]
    shared = "".join(rng.choice(list("abcdefgh "), 600))
    rows = [*alone, *[(100 + i, shared) for i in range(30)], (200, "x" + shared), (201, shared + "y"), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r["doc"]: r["n_removed"] for r in suffix_dedup.dedup_report(df, keep_first=False).collect()}
    assert got == {i: 0 if i is not None and i < 100 else 600 for i, _ in rows}
    stored = kept["anchors"].groupBy("doc").count().collect()
    assert {r["doc"] for r in stored} == {i for i, _ in rows if i is None or i >= 100}
    # every anchor of the copies is there once, however they were dealt
    own = suffix_dedup._anchor_rows(suffix_dedup._keys(df, "doc_id", "text"), suffix_dedup.LENGTH)
    assert kept["anchors"].count() == own.filter("doc is null or doc >= 100").count()


def test_contexts_are_ordered_as_strings():
    """A block sorts its contexts, not all their bytes as suffixes."""
    strings = [b"abc", b"abd", b"ab", b"x", b"abc"]
    order, shared = suffix_dedup.common_prefixes(strings, np.array([0, 0, 0, 0, 1]))
    assert [strings[i] for i in order] == [b"ab", b"abc", b"abd", b"x", b"abc"]
    assert shared.tolist() == [-1, 2, 2, 0, -1]


def test_removed_spans_hold_whole_characters(docs):
    cut = suffix_dedup.remove_repeats(docs, length=200)
    assert cut.columns == docs.columns and cut.count() == len(TEXTS)
    text = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert text[4] is None and text[7].count("passage") > 50 and "passage30" not in text[8]


def test_statistics_and_base_rules(docs, none, spark):
    labels = spark.createDataFrame([(1, True)], "doc_id bigint, good boolean")
    for r in quality_rules.judge(docs, labels).collect():
        text = next(t for k, t, *_ in TEXTS if k == r["doc_id"]) or ""
        w = WORD.findall(text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = collections.Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if often[x] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"])  # one label certifies nothing
    assert quality_rules.judge(none, labels).count() == 0


def test_lines_of_texts_that_begin_with_a_feed():
    texts = ["a\nb\na", "\nc\nd\nc", "", "\n", "\n\ne\ne\n", "\nf", "g\n", "\ng\ng", None, "\nh\n"]
    got = quality_rules.batch_statistics(pa.array(texts))
    for k, text in enumerate(texts):
        lines = [x for x in (text or "").split("\n") if x]
        assert (got["n_lines"][k], got["n_dup_lines"][k]) == (len(lines), len(lines) - len(set(lines))), text


def test_cutoffs_are_certified():
    def direct(k, n, p):
        total, term = 0.0, (1 - p) ** n
        for i in range(k + 1):
            total += term
            term *= (n - i) / (i + 1) * p / (1 - p)
        return total

    for k, n, p in ((0, 100, 0.02), (3, 900, 0.01), (1, 50, 0.1)):
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(direct(k, n, p))
    assert quality_rules.choose_cutoff([0, 0, 40], [5, 9, 9], 2000, 0.01, 0.01) == 1
    assert quality_rules.choose_cutoff([0, 0, 40], [5, 9, 9], 10, 0.01, 0.01) is None


def test_certified_rules_reject_planted_junk(spark):
    rows = [(i, f"plain words number {i} " + " ".join(f"w{i}x{k}" for k in range(60)), "en") for i in range(1500)]
    rows += [(10_000 + i, " ".join(f"w{i}y{k}###" for k in range(60)), "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).alias("good"))
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).filter("kept").collect()}
    assert kept == set(range(1500))


def test_machine_learns_and_scores_everything(spark, docs, none):
    rows = [(i, "clean prose here " + " ".join(f"w{k}{i}" for k in range(80)), True) for i in range(150)]
    rows += [(1000 + i, " ".join(f"BAD!! ###{k}" for k in range(60)), False) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, good boolean")
    train, test = table.filter("doc_id % 4 <> 2"), table.filter("doc_id % 4 = 2")
    machine = factorisation.train(table, train.select("doc_id", "good"))
    scored = factorisation.score(test, machine).collect()
    assert all((r["score"] >= 0.7) == r["good"] for r in scored)
    every = factorisation.score(docs, machine)
    assert every.columns == [*docs.columns, "score"]
    assert all(0 <= r["score"] <= 1 for r in every.collect()) and factorisation.score(none, machine).count() == 0
    nothing = factorisation.train(none, train.filter("false").select("doc_id", "good"))
    assert factorisation.score(docs, nothing).filter("score = 0.5").count() == len(TEXTS)


def test_pairwise_identity():
    rng = np.random.default_rng(4)
    w, v = rng.normal(size=50), rng.normal(size=(50, 3))
    index, value = np.array([3, 7, 9, 1]), np.array([0.5, 2.0, -1.0, 1.0])
    pairs = sum(v[a] @ v[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(index[:3], value[:3]), 2))
    got = factorisation.Machine(0.25, w, v).margins(index, value, np.array([3, 1]))
    assert got[0] == pytest.approx(0.25 + w[[3, 7, 9]] @ value[:3] + pairs) and got[1] == pytest.approx(0.25 + w[1])


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", r"a <\|im_end|> b <\\| c", "<|", "", None, "plain\n\nlines", "\\n<"]
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate(zip(["user", "assistant", "sys\nte<m\\", None, "assistant", "user", "assistant"], hard))]
    rows += [(None, 0, "user", "no id", "x"), (2, 1, "b", "tie", "x"), (2, 1, "a", "tie", "x"), (2, 1, "a", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r or "", t or "") for _, _, r, t, _ in rows[:7]]
    assert got[1]["n_escaped"] == 2 and got[1]["formatted"].count(chat.END) == 7
    assert [t["role"] for t in got[2]["turns"]] == ["a", "a", "b"] and got[None]["formatted"].endswith("no id<|im_end|>\n")
    spans = chat.format_conversations(df).select("formatted", "turns", chat.loss_spans(F.col("turns"), F.col("formatted")).alias("s"))
    for r in spans.collect():
        said = [t["text"] for t in r["turns"] if t["role"] == "assistant"]
        shown = [r["formatted"][x["start"] : x["end"]] for x in r["s"]]
        assert [re.sub(r"<(\\*)\\\|", r"<\1|", x) for x in shown] == said
    assert chat.format_conversations(df.filter("false")).count() == 0


def test_mixing_reaches_targets(spark, docs, none):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(n), "abcde"[int(s)]) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 3000), rng.choice(5, 3000, p=[0.02, 0.4, 0.38, 0.1, 0.1])))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_copies(df, bins=64).toPandas()
    again = mixing.mix_copies(df.repartition(3), bins=64).toPandas()
    assert got.sort_values("key").reset_index(drop=True).equals(again.sort_values("key").reset_index(drop=True))
    got["taken"] = got["copies"] * got["size"]
    assert got["copies"].max() <= 3
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((per.taken - per.target).abs() <= 60).all() and (per.target <= 3 * per["size"] + 1e-6).all()
    assert per.target.sum() == pytest.approx(per["size"].sum())
    assert mixing.mix_copies(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {(r["key"], r["source"]): r["copies"] for r in mixing.mix_copies(docs).collect()}
    assert sum(v * (2 if k[0] == 8 else 1) for k, v in copies.items()) == mixed.count()


def test_weights_shift_inclusion(spark):
    rows = [(i, "w " * 10, "s", 4.0 if i % 2 else 1.0) for i in range(2000)] + [(9999, "w " * 20_000, "t", 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, wanted double")
    got = mixing.mix_copies(df, weight="wanted", weights=(1, 1), most_copies=3).filter("source = 's'").toPandas()
    even, odd = (got[got.key % 2 == k].copies.mean() for k in (0, 1))
    assert odd > 1.5 * even


def test_cascade_is_exact(spark):
    keys = [(f"host{i}.example.org",) for i in range(4000)]
    universe = spark.createDataFrame(keys, "key string")
    listed = universe.filter(F.crc32(F.col("key").cast("binary")) % 7 == 0)
    cascade = url_filter.BloomCascade.build(listed.union(spark.createDataFrame([("absent",)], "key string")), universe)
    found = universe.filter(cascade.contains(F.col("key")))
    assert len(cascade.levels) > 1 and found.exceptAll(listed).count() == 0 and found.count() == listed.count()
    assert universe.exceptAll(found).count() == 4000 - listed.count()
    assert url_filter.listed_by_join(universe, listed).count() == listed.count()


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q#f"), (2, "https://example.net"), (3, None), (4, "no scheme"), (5, "x://"),
        (6, "http://my-net/x"), (7, "http://b.bad.org/a"), (8, "http://b.bad.org/fr/a"), (9, "a://b://c/d"), (9, "a://b://c/d"),
    ]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id bigint, url string, host string")
    listed = spark.createDataFrame([("bad.org",), (None,)], "key string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(df, listed, catalog.RULES, most_labels=2).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow", False)
    assert got[2] == ("example.net", "", None, "allow", False)
    assert got[3] == got[4] == got[5] == ("", "", None, "allow", False)
    assert got[6] == ("my-net", "/x", None, "allow", False)
    assert got[7] == ("b.bad.org", "/a", None, "block", True) and got[8][2:4] == ("org/fr/", "allow")
    assert got[9] == ("b:", "//c/d", None, "allow", False)
    assert url_filter.judge_urls(df.filter("false"), listed, catalog.RULES, most_labels=2).count() == 0


PAGE = (
    "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav>"
    "<div class=\"ad\">Buy now</div><article><h1>Title &amp; more</h1><p><b>First\n  part.<br>still <p>Second &lt;part&gt;.</p>"
    "<p>Third part, {}.</article><footer>&copy; site</footer></body></html>"
)


def test_pages(spark):
    rows = [(i, f"u{i}", PAGE.format(f"number {i}")) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<p"), (103, "u", PAGE.format("cut")[:300])]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    field = html_crf.train(df)
    got = {r["page_id"]: r["text"] for r in html_crf.extract(df, field).collect()}
    assert got[7] == "Title & more\nFirst part. still\nSecond <part>.\nThird part, number 7."
    assert got[100] == got[101] == got[102] == "" and got[103].startswith("Title & more\nFirst part.")
    other = PAGE.replace("<article>", '<div class="content">').replace("</article>", '<div class="comments"><p>Nice post.</p></div></div>')
    text = html_crf.main_text(other.replace("<footer>", '<div class="footer">').replace("</footer>", "</div>").format("z"), field)
    assert text == "Title & more\nFirst part. still\nSecond <part>.\nThird part, z."
    assert html_crf.extract(df.filter("false"), html_crf.train(df.filter("false"))).count() == 0


def test_field_decodes_the_best_path():
    rng = np.random.default_rng(8)
    field = html_crf.Field(rng.normal(size=html_crf.SLOTS), rng.normal(size=(2, 2)) * 2)
    blocks = [html_crf.Block(f"text {i}" * (i + 1), ["div", "p"][: i % 3], [f"n{i}"], 0.0) for i in range(7)]
    scores = [field.w[f].sum() for f in html_crf.block_features(blocks)]

    def value(path):
        return sum(s for s, y in zip(scores, path) if y) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product((0, 1), repeat=7), key=value)
    assert value(field.decode(blocks)) == pytest.approx(value(best))


@pytest.fixture(scope="module")
def model():
    pytest.importorskip("sentencepiece")
    return sentencepiece_lattice.Model.load(sentencepiece_lattice.default_model())


def library(model):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(sentencepiece_lattice.default_model(), "rb") as f:
        spec.ParseFromString(f.read())
    for piece, score in zip(spec.pieces, model.scores):
        piece.score = score
    spec.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())


@pytest.mark.parametrize("most", [10**6, 5])
def test_encoding_equals_the_unigram_search_and_decodes(spark, docs, none, model, most):
    texts = [" two  spaces", "héllo wörld", "日本語\n\ttext", "tail ", "x" * 200, "▁mark", "l'été», «word»?! a1b2... (x)", "  😀 end."]
    rows = spark.createDataFrame([(50 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text", "ids").unionByName(rows, allowMissingColumns=True)
    encoded = sentencepiece_lattice.encode(every, model, most_chunks=most)
    back = sentencepiece_lattice.decode(encoded, model).collect()
    assert len(back) == len(TEXTS) + len(texts)
    lib = library(model)
    for r in back:
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
        text = r["text"] or ""
        if "\n" not in text and text != "▁mark":
            assert lib.decode(r["ids"]) == text and sum(model.scores[i] for i in r["ids"]) == pytest.approx(
                sum(model.scores[i] for i in lib.encode(text)), abs=1e-3
            )
    assert sentencepiece_lattice.encode(none, model).count() == 0


@pytest.mark.parametrize("most", [10**6, 5])
def test_long_runs_are_not_cut(spark, model, most):
    rng = np.random.default_rng(13)
    lib = library(model)
    pool = [p for p in model.pieces if len(p) > 2 and p.isalnum()]
    texts = ["".join(rng.choice(pool, 60)) for _ in range(20)] + ["".join(rng.choice(list("中文日本語的是不了人我在有他这"), 300)), "7" * 301, "a" + " " * 130 + "b", "=" * 333]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encoded = sentencepiece_lattice.encode(df, model, most_chunks=most)
    for r in sentencepiece_lattice.decode(encoded, model).collect():
        assert r["decoded"] == r["text"]
        best = sum(model.scores[i] for i in lib.encode(r["text"]))
        assert sum(model.scores[i] for i in r["ids"]) == pytest.approx(best, abs=1e-3), r["text"]


def test_chunks_are_cut_as_the_pattern_says():
    rng = np.random.default_rng(3)
    signs = list("aZ9 \n\t.éÀÿ×÷ŁǅɏɐȀ▁▂日😀Ωß\u00bf\u00c0") + [" ", "\n", "a"]
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 60, 400)] + [None, "", " ", "▁", "\n", "x\n", "\ny"]
    for pattern in (sentencepiece_lattice.CHUNK, sentencepiece_lattice.FINE_CHUNK):
        data, offsets = sentencepiece_lattice.spaced(pa.array(texts))
        starts, ends, counts = sentencepiece_lattice.cut_chunks(data, offsets, pattern == sentencepiece_lattice.FINE_CHUNK)
        got = iter(data[b:e].tobytes().decode().replace(" ", "▁") for b, e in zip(starts, ends))
        for t, count in zip(texts, counts):
            assert list(itertools.islice(got, count)) == (re.findall(pattern, "▁" + t.replace(" ", "▁")) if t else [])
        assert next(got, None) is None


def test_one_way_for_every_size(spark, model, monkeypatch):
    """Neither the table's size nor the sample changes ids or plan; texts cross the join packed."""
    texts = [f"line {i % 7} of {i} words,\nrare{i * i} été " * (i % 5) for i in range(300)] + [None, "", "7" * 90 + " x"] * 2
    df = spark.createDataFrame([(i % 290, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, n int")
    ids, plans = [], []
    for most, sample in ((10**6, 1 << 27), (10**6, 500), (20, 1 << 27), (0, 1 << 27)):
        monkeypatch.setattr(sentencepiece_lattice, "SAMPLE_BYTES", sample)
        monkeypatch.setattr(sentencepiece_lattice, "_PACK_BYTES", 3000)
        encoded = sentencepiece_lattice.encode(df, model, most_chunks=most)
        assert encoded.columns == ["doc_id", "text", "n", "ids"]
        ids.append(sorted((r["n"], r["doc_id"], r["text"], r["ids"]) for r in encoded.collect()))
        plans.append(re.findall("Join|Aggregate|MapInArrow|Generate", encoded._jdf.queryExecution().optimizedPlan().toString()))
    assert len(ids[0]) == len(texts) and all(x == ids[0] for x in ids) and all(x == plans[0] for x in plans)
    joined = encoded._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert "rows#" in joined and "more#" in joined


def test_packs_of_another_order_still_encode(spark, model):
    """Chunks that the join did not bring are searched where they are met."""
    known = sentencepiece_lattice.ChunkTable(np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint16))
    long = sentencepiece_lattice.LongChunks.of(model)
    batch = pa.RecordBatch.from_pydict({"text": ["two words", None, "日本語\n words"]})
    out = sentencepiece_lattice._with_ids(batch, 0, None, known, long, True)
    want = sentencepiece_lattice.encode(spark.createDataFrame([(t,) for t in batch.to_pydict()["text"]], "text string"), model)
    found = {r["text"]: r["ids"] for r in want.collect()}
    assert out.to_pydict()["ids"] == [found[t] for t in batch.to_pydict()["text"]]


def test_long_search_equals_the_fold(spark, model):
    chunks = spark.createDataFrame([("▁" + "ab1" * 9, 1), ("日本😀x" * 4, 1), ("▁▁▁▁▁the", 1), ("information", 2)], "chunk string, n bigint")
    long = sentencepiece_lattice.LongChunks.of(model)
    for r in sentencepiece_lattice.encode_chunks(chunks, model).collect():
        assert long.ids(r["chunk"]).tolist() == r["ids"]


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    start = spark.read.parquet(f"{folder}/documents.parquet")
    for d in (start, start.filter("false")):
        for name, step in corpus_pipeline.STAGES[:-1]:
            d = step(spark, d, folder)
            assert d.columns == start.columns, name
            d.write.parquet(str(tmp_path / f"{name}{d.columns and id(d)}"))
            d = spark.read.parquet(str(tmp_path / f"{name}{id(d)}"))
        out = corpus_pipeline.STAGES[-1][1](spark, d, folder)
        assert out.filter("not round_trip").count() == 0
