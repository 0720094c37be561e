"""Conversation repair, the prefix trie and the toxicity models against plain computations."""

from __future__ import annotations

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stationcast.llm import catalog, kneser_ney, prefix_trie, structure_repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROW = "conv_id bigint, turn bigint, role string, text string, `place` string, `audit` string"
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLES = (("u", "user"), ("a", "assistant"))


def random_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for c in range(-20, n):
        for i in range(rng.choice([0, 1, 2, 3, 4, 5, 9])):
            turn = rng.choice([None, i, i, i, i + rng.randint(0, 2)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c if c else None, turn, role, rng.choice(["a b.", "b", "c!", "", "  ", "d.  ", "e ", None, "f?\n"]), "x", "y"))
    return rows


# --- repair ---------------------------------------------------------------------


def damaged(rows):
    out = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        out[c] += []
        tag, r, x = f"{' ' if c is None else c}:{' ' if t is None else t}", " " if r is None else r, " " if x is None else x
        hit = zlib.crc32(tag.encode()) % 20
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        out[c] += [(t, "user" if hit == 4 else r, x)] * {0: 0, 3: 2}.get(hit, 1)
    return {c: sorted(v, key=lambda a: (a[0] is not None, a[0] or 0, a[1], a[2])) for c, v in out.items()}


def cheapest(rows):
    """Least cost, then least audit, by a search over whole edit strings."""
    seen, faults = set(), []
    for _, r, x in rows:
        chars = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append("blank" if not chars else "duplicate" if (r, x) in seen else "truncated" if chars[-1] not in ".!?" else None)
        seen.add((r, x))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, turns = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for ch, role in ROLES:
            if (state, ch) in GRAMMAR:
                heapq.heappush(heap, (cost + 3, audit + "I", i, GRAMMAR[state, ch], (*turns, (role, ""))))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, turns))
            if faults[i] not in ("blank", "duplicate"):
                cost += 3 if faults[i] else 0
                if (state, r[:1]) in GRAMMAR:
                    heapq.heappush(heap, (cost, audit + "K", i + 1, GRAMMAR[state, r[:1]], (*turns, (r, x))))
                for ch, role in ROLES:
                    if (state, ch) in GRAMMAR:
                        heapq.heappush(heap, (cost + 3, audit + "R", i + 1, GRAMMAR[state, ch], (*turns, (role, x))))
    known = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest(),
    }


def test_repair_against_a_search_over_edit_strings(spark):
    rows = random_rows(1)
    rows += rows[:30]
    table = spark.createDataFrame(rows, ROW)
    found = catalog.with_digests(structure_repair.repair(catalog.damaged(table), present=F.col("present"))).collect()
    want = {c: cheapest(v) for c, v in damaged(rows).items()}
    assert len(found) == len(want)
    for r in found:
        assert {k: r[k] for k in want[r.conv_id]} == want[r.conv_id], r.conv_id


def test_repair_of_nothing_and_of_emptied_conversations(spark):
    table = spark.createDataFrame([(7, 0, "user", "a.", "", ""), (7, 1, "user", "", "", "")], ROW)
    assert structure_repair.reports(table.filter("false")).collect() == []
    gone = catalog.with_digests(structure_repair.repair(table, present=F.lit(False))).first()
    assert (gone.conv_id, gone.gaps, gone.cost, gone.audit) == (7, 0, 0, "")
    assert gone.repaired_sha256 == hashlib.sha256(b"").hexdigest()
    turns = structure_repair.repaired_turns(table).orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in turns] == [("K", "user", "a."), ("I", "assistant", "")]


def test_repair_streams_a_long_conversation_and_spills(spark, monkeypatch):
    monkeypatch.setattr(structure_repair, "SPILL_BYTES", 1 << 12)
    long = "wort " * 40_000 + "ende."
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i} ist da.", "", "") for i in range(30_000)] + [(2, 0, "tool", long, "", "")]
    found = {r.conv_id: r for r in structure_repair.reports(spark.createDataFrame(rows, ROW)).collect()}
    assert (found[1].cost, found[1].audit) == (0, "K" * 30_000)
    assert (found[2].cost, found[2].audit) == (4, "D")
    # the same walk in this process, where the files really are small
    table = structure_repair.Transitions()
    whole = structure_repair.Conversation(1, table)
    for i in range(5_000):
        whole.add(i, "user", f"{i}.", False, i % 3 == 0, False)
    out = list(whole.finish())
    assert out[-1][-1].count("D") >= 1667 and [r[1] for r in out[:-1]] == list(range(len(out) - 1))
    assert len(table.back) < 200  # few transitions whatever the length


# --- trie -----------------------------------------------------------------------


def trie(rows, rebased):
    turns = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        r, x = r or "", x or ""
        token = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16]
        turns[c].append((t is not None, t or 0, token, r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebased and c is not None else 0
        base = None if c is None else c - int(math.fmod(c, 20))
        whole[c] = own.get(base, [])[:h] + v[h:]
    members, children = collections.defaultdict(set), collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)

    def least(p):
        return min((c for c in members[p] if c is not None), default=None)

    def digest(p):
        ends = sorted((c for c in members[p] if len(whole[c]) == len(p)), key=lambda c: (c is not None, c or 0))
        return hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()

    return sorted(
        str((least(p), len(p), least(p[:-1]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], digest(p)))
        for p in members
    )


@pytest.mark.parametrize("shards", [1, 3, 60])
def test_trie_against_a_dictionary_of_prefixes(spark, shards):
    rows = random_rows(2) + [(1000 + i, 0, "user", "same", "", "") for i in range(200)]
    rows += [(5000 + i, t, "user", f"turn {t}", "", "") for i in range(40) for t in range(90 + i)]  # longer than a splitter
    table = spark.createDataFrame(rows, ROW)
    for rebased in (False, True):
        found = prefix_trie.paths(table)
        found = prefix_trie.rebased(found) if rebased else found
        assert sorted(str(tuple(r)) for r in prefix_trie.build(found, shards=shards).collect()) == trie(rows, rebased)


def test_trie_of_nothing_and_splitters(spark):
    none = spark.createDataFrame([], ROW)
    assert prefix_trie.build(prefix_trie.rebased(prefix_trie.paths(none))).collect() == []
    a, b, c = (bytes([i]) * 16 for i in range(3))
    skeleton = prefix_trie.Skeleton.of([a + b, a + b + c, a + c, b], 4)
    assert skeleton.splitters == [a + b + c, a + c, b]
    assert set(skeleton.number) == {b"", a, a + b}
    assert prefix_trie.Skeleton.of([a, a, a], 8).splitters == []
    assert [prefix_trie.shared(x, y) for x, y in ((a, a + b), (a + b, a + c), (b"", a), (a + b + c, a + b + b))] == [1, 1, 0, 2]


# --- toxicity -------------------------------------------------------------------


def plain(text):
    return " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), (text or "").replace("\0", " ")).encode().decode().split(" ")).encode()


def squeezed(text):
    return re.sub(rb"[\x20\x09-\x0D\x00]+", b" ", plain(text)).strip(b" ")


def tables_of(texts):
    """Counts of one model, order by order, by dictionaries."""
    level = collections.Counter()
    for t in texts:
        padded = b"\0" * (kneser_ney.ORDER - 1) + squeezed(t)
        level.update(padded[i : i + kneser_ney.ORDER] for i in range(len(padded) - kneser_ney.ORDER + 1))
    return level


def test_streams_and_strings():
    texts = ["The  Cat\n", "", None, " x\0y ", "é", "a\tb" * 3]
    stream, zeros = kneser_ney.plain_stream(pa.array(texts))
    assert bytes(stream).split(b"\0")[1:] == [squeezed(t) for t in texts]
    got = collections.Counter()
    for begin in range(0, len(stream), 4):  # parts do not matter
        _, found = kneser_ney.strings(stream, zeros, begin, min(begin + 4, len(stream)))
        got.update(int(x).to_bytes(kneser_ney.ORDER, "big") for x in found)
    assert got == tables_of(texts)


TOXIC_WORDS = ("idiot", "scum", "moron")


def labelled(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(["an", "the", "ti", "on", "er", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(15, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(1 + len(words) // 20):
                words[rng.randrange(len(words))] = rng.choice(TOXIC_WORDS)
        rows.append((i, " ".join(words), bad))
    return rows


def test_models_against_dictionaries_and_add_up(spark):
    rows = labelled(60)
    counts = kneser_ney.count_strings(spark.createDataFrame([(t, b) for _, t, b in rows], "text string, toxic boolean"))
    levels = kneser_ney.fit(counts)
    # the same models by dictionaries
    order = kneser_ney.ORDER
    top = [tables_of([t for _, t, b in rows if b == toxic]) for toxic in (False, True)]
    levelled = {order: top}
    for k in range(order - 1, 0, -1):
        above = levelled[k + 1]
        lower = [collections.Counter(g[1:] for g, n in above[c].items() if n) for c in (0, 1)]
        if k <= kneser_ney.SHARED:
            lower = [collections.Counter(g[1:] for g in set(above[0]) | set(above[1]))] * 2
        levelled[k] = lower

    kept = {}
    for k, (ordinary, toxic) in levelled.items():
        slots = collections.defaultdict(list)
        for g in set(ordinary) | set(toxic):
            number = int.from_bytes(g, "big")
            slots[number % kneser_ney.SLOTS[k]].append((ordinary[g] + toxic[g], number, g))
        kept[k] = {max(x)[2] for x in slots.values()}

    def chance(c, gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        counts = levelled[k][c]
        once, twice = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        off = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
        after = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return chance(c, gram[1:])
        own = {g: max(n - off, 0) / total for g, n in after.items() if g in kept[k]}
        return own.get(gram, 0) + (1 - sum(own.values())) * chance(c, gram[1:])

    model = kneser_ney.Model(levels)
    rng = random.Random(1)
    grams = rng.sample(sorted(top[0]), 60) + rng.sample(sorted(top[1]), 60) + [b"zzzzz", b"\0\0\0\0q", b"idiox"]
    got = model.ratios(np.array([int.from_bytes(g, "big") for g in grams], dtype=np.uint64))
    want = [math.log(chance(1, g)) - math.log(chance(0, g)) for g in grams]
    np.testing.assert_allclose(got, want, atol=1e-5)
    for context in (b"\0\0\0\0", b" the", b"diot"):
        for c in (0, 1):
            assert sum(chance(c, context + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_held_out_texts_are_told_apart(spark):
    rows = labelled(600)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id bigint, text string, score string")
    known = spark.createDataFrame([(i, b) for i, _, b in rows if i % 3], "doc_id bigint, toxic boolean")
    model = kneser_ney.train(docs, known)
    assert model.power in kneser_ney.POWERS
    got = {r.doc_id: r.score for r in kneser_ney.score(docs, model).collect()}
    held = [(got[i] >= 0.5, b) for i, _, b in rows if i % 3 == 0]
    assert sum(p for p, b in held if b) >= 0.95 * sum(b for _, b in held)
    assert sum(p for p, b in held if not b) <= 2


def test_toxicity_of_awkward_rows(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (None, "idiot"), (3, "x " * 300_000), (3, "x " * 300_000), (4, "\0 \n")], "doc_id bigint, text string"
    )
    none = spark.createDataFrame([], "doc_id bigint, toxic boolean")
    one = spark.createDataFrame([(3, True), (None, True)], "doc_id bigint, toxic boolean")
    for known, want in ((none, 0.5), (one, 0.99)):
        assert {round(r.score, 6) for r in kneser_ney.score(docs, kneser_ney.train(docs, known)).collect()} == {want}
    both = spark.createDataFrame([(1, False), (2, True), (3, True), (4, False), (3, False)], "doc_id bigint, toxic boolean")
    scores = kneser_ney.score(docs, kneser_ney.train(docs, both)).collect()
    assert len(scores) == 6 and all(0 <= r.score <= 1 for r in scores)
    assert len({r.score for r in scores if r.doc_id in (1, 2, 4)}) == 1
    assert kneser_ney.score(docs.filter("false"), kneser_ney.train(docs.filter("false"), both)).collect() == []


def test_cut_between_the_classes():
    wrong, cut, slope = kneser_ney.choose_cut(np.array([5.0, 4.0, 1.0, 0.0, 0.0]), np.array([True, True, False, False, True]))
    assert (wrong, cut) == (1, 2.5) and slope == pytest.approx(3.5 / 8)
    power, _, _ = kneser_ney.best_power(np.array([4.0, 40.0, 2.0, 20.0]), np.array([4, 1600, 4, 1600]), np.array([True, True, False, False]))
    assert power == 0.5


def test_no_string_is_lost_where_slots_and_tasks_hold_few(spark, monkeypatch):
    """97 slots an order and a handful of others give the scores that room for all gives."""
    rows = labelled(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, "new words, never counted"), (101, None), (100, rows[0][1])], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id bigint, toxic boolean")

    def scores():
        return sorted((r.doc_id, r.score) for r in kneser_ney.score(docs, kneser_ney.train(docs, known)).collect())

    want = scores()
    monkeypatch.setattr(kneser_ney, "SLOTS", dict.fromkeys(range(1, 6), 97))
    for more in (1 << 20, 7):
        if more == 7:
            monkeypatch.setattr(kneser_ney, "MOST_MORE", more)
        got = scores()
        assert [i for i, _ in got] == [i for i, _ in want]
        np.testing.assert_allclose([x for _, x in got], [x for _, x in want], atol=1e-4)
