"""The operators that SQL cannot express, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import log10
from zlib import crc32

import numpy as np
import pytest

from vesperine.llm import chunk_dedup, ctw, decontaminate, langid, minhash, suffix_dedup
from vesperine.llm import textbytes as tb

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score string, block string")


def odd_rows():
    """Nulls, empties, ties, a long text, repeats and clashing columns."""
    rng = random.Random(5)
    words = ["alpha", "bet", "gam", "delta", "é", "zeta", "the", "of"]
    base = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(80))
    rows = [(1, base), (2, base), (3, base + " tail one two three"), (4, None), (5, ""), (6, "   \n"), (7, "one"), (8, "one two")]
    rows += [(9, "One two"), (10, base.upper()), (11, base[40:260] + " other text here " + base[:120]), (12, "é" * 70), (13, "xé" + "é" * 70)]
    rows += [(14, "a" * 500), (15, "b" + "a" * 300), (16, " ".join(rng.choice(words) for _ in range(30_000))), (17, base.replace("alpha", "omega", 1))]
    return [(i, t, "s", "b") for i, t in rows]


def brute_suffix(rows, length=50):
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = True
        edge = np.diff(np.concatenate(([0], gone, [0])).astype(int))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def suffix_rows(df):
    return {
        r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in df.collect()
    }


@pytest.mark.parametrize("block_bytes", [2_000, 1 << 22])
def test_suffix_dedup_equals_brute_force(spark, block_bytes):
    rows = [r for r in odd_rows() if r[0] != 16]
    got = suffix_rows(suffix_dedup.suffix_dedup(frame(spark, rows), block_bytes=block_bytes))
    assert got == brute_suffix([r[:2] for r in rows])


def test_suffix_dedup_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = suffix_rows(suffix_dedup.suffix_dedup(docs, block_bytes=60_000))
    assert got == brute_suffix([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block_bytes", [400, 1 << 22])
def test_suffix_dedup_cuts_every_place_in_a_document(spark, block_bytes):
    """Passages once in an earlier document and twice in a later one, in the
    same line there, so that the runs at their ends are equal to each other but
    not to the earlier document's."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for k, n in enumerate([50, 52, 56, 60, 64, 70, 75, 90, 140]):
        passage, line = text(n), (text(60), text(60))
        rows.append((2 * k, text(80) + passage + text(80)))
        rows.append((2 * k + 1, text(70) + line[0] + passage + line[1] + text(90) + line[0] + passage + line[1] + text(40)))
    got = suffix_rows(suffix_dedup.suffix_dedup(frame(spark, [(*r, "s", "b") for r in rows]), block_bytes=block_bytes))
    assert got == brute_suffix(rows)


@pytest.mark.parametrize("hot", [0, 3])
def test_suffix_dedup_of_a_passage_in_many_surroundings(spark, hot):
    """The names at a common passage's edges are hot: their windows are spread."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    passage, word = text(120), "ab " * 400
    rows = [(k, text(rng.randrange(90)) + passage + text(rng.randrange(90))) for k in range(60)]
    rows += [(60, word), (61, word + text(60)), (61, passage + text(30) + passage), (None, passage[5:100] + text(9))]
    found = suffix_dedup.suffix_dedup(frame(spark, [(*r, "s", "b") for r in rows]), block_bytes=2000, hot=hot).collect()
    least = {None: -(2**63)}  # a null id is less than all others
    twins = [r for r in rows if r[0] == 61]  # rows of one id remove nothing from each other
    want = [brute_suffix([(least.get(i, i), t) for i, t in rows if (i, t) != twin]) for twin in twins]
    for r in found:
        got = (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256)
        assert got in [w[least.get(r.doc_id, r.doc_id)] for w in want]
    assert len(found) == len(rows)


def test_longest_previous_factors():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(12)]
    docs = np.array([rng.randrange(6) for _ in texts])
    buf, need = np.frombuffer(b"".join(texts), np.uint8), np.full(12, 29)
    found = np.split(suffix_dedup.longest_previous(buf, np.arange(12) * 40, need, docs, 12), 12)
    for i, (t, lpf) in enumerate(zip(texts, found)):
        for p in range(29):
            want = 0
            for j, u in enumerate(texts):
                if docs[j] < docs[i]:
                    for q in range(29):
                        k = 0
                        while k < 12 and t[p + k] == u[q + k]:
                            k += 1
                        want = max(want, k)
            assert lpf[p] == want


def sets_of(text, k, percent_words=WORD):
    low = (text or "").encode().translate(bytes(tb.LOWER)).decode()
    w = percent_words.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_near(rows, k, percent):
    sets = {i: sets_of(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for i, s in sets.items():
        for j in set().union(*(by[x] for x in s)) if s else ():
            if i < j and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("group_shingles", [minhash.GROUP_SHINGLES, 400])
def test_near_duplicates_equal_brute_force(spark, group_shingles):
    rows = [r[:2] for r in odd_rows() if r[0] != 16]
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    for i in range(60):  # a chain of copies that drift apart
        base = list(base)
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = f"v{rng.randrange(10**6)}"
        rows.append((100 + (i * 37) % 61, " ".join(base)))
    df = frame(spark, [(*r, "s", "b") for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, shingle=3, percent=85, group_shingles=group_shingles).collect()}
    assert got == brute_near(rows, 3, 85)


def test_near_duplicates_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == brute_near([(r.doc_id, r.text) for r in docs.collect()], 3, 85)


def test_word_and_shingle_hashes_do_not_depend_on_place():
    buf, off = tb.column(__import__("pyarrow").array(["ab cd", None, "xx ab  cd", "cd"]))
    starts, ends, first = tb.words(buf, off)
    h = tb.word_hashes(buf, starts, ends)
    assert first.tolist() == [0, 2, 2, 5, 6]
    assert h[0] == h[3] and h[1] == h[4] == h[5] and len(set(h.tolist())) == 3


def test_unigram_scores_equal_brute_force(spark):
    rows = [r[:2] for r in odd_rows()]
    count, n = Counter(), 0
    tokens = {i: [w.encode().translate(bytes(tb.LOWER)).decode() for w in WORD.findall(t or "")] + [None] for i, t in rows}
    for i, ts in tokens.items():
        if crc32(str(i).encode()) % 7 != 2:
            count.update(ts)
            n += len(ts)
    got = {r.doc_id: r for r in ctw.score(frame(spark, [(*r, "s", "b") for r in rows]), block_bytes=3_000).collect()}
    assert len(got) == len(rows)
    for i, ts in tokens.items():
        r = got[i]
        want = sum(log10((count[t] + 1) / (n + len(count) + 1)) for t in ts)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(count[t] > 0 for t in ts), n)
        assert r.held_out == (crc32(str(i).encode()) % 7 == 2)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        assert r.score < 0


def test_context_tree_is_a_distribution_and_equals_recursion():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abc ") for _ in range(60)) for _ in range(6)]
    counts = Counter()
    for t in texts:
        cls = [int(ctw.CLASS[0xFF])] * 3 + [int(ctw.CLASS[b]) for b in t]
        for k, s in enumerate(list(t) + [0xFF]):
            counts[cls[k + 2] * 1600 + cls[k + 1] * 40 + cls[k], s] += 1
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ctx, sym, _ = ctw._events(buf, np.arange(0, 361, 60))
    assert Counter(zip(ctx.tolist(), sym.tolist())) == counts
    keys = sorted(counts)
    model = ctw.train(np.array([c * 256 + s for c, s in keys]), np.array([counts[k] for k in keys], float))
    assert np.allclose((10.0 ** model.logp.astype(float)).sum(axis=1), 1, atol=1e-4)

    def kt(a, b):  # by its sequential definition
        p, x, y = 1.0, 0, 0
        for bit in [0] * a + [1] * b:
            p *= ((y if bit else x) + 0.5) / (x + y + 1)
            x, y = x + (1 - bit), y + bit
        return p

    def node(depth, key, level, prefix):
        a = b = 0
        for (c, s), n in counts.items():
            if c // 40 ** (3 - depth) == key and s >> (8 - level) == prefix:
                if s >> (7 - level) & 1:
                    b += n
                else:
                    a += n
        return a, b

    def weighted(depth, key, level, prefix):
        own = kt(*node(depth, key, level, prefix))
        if depth == 3:
            return own, own
        below = 1.0
        for child in {c // 40 ** (2 - depth) for c, _ in counts if c // 40 ** (3 - depth) == key}:
            below *= weighted(depth + 1, child, level, prefix)[0]
        return 0.5 * own + 0.5 * below, own

    def predict(ctx, level, prefix, depth=0):
        a, b = node(depth, ctx // 40 ** (3 - depth), level, prefix)
        one = (b + 0.5) / (a + b + 1)
        if depth == 3:
            return one
        total, own = weighted(depth, ctx // 40 ** (3 - depth), level, prefix)
        w = 0.5 * own / total
        return w * one + (1 - w) * predict(ctx, level, prefix, depth + 1)

    for ctx, s in [keys[0], keys[len(keys) // 2], (keys[3][0], ord("z"))]:
        want = 0.0
        for level in range(8):
            one = predict(ctx, level, s >> (8 - level))
            want += log10(one if s >> (7 - level) & 1 else 1 - one)
        assert abs(model.logp[model.row[ctx], s] - want) < 1e-3


def test_real_contexts_equal_recursion_and_sum_to_one():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab ") for _ in range(50)) for _ in range(8)] + ["жзж ззж".encode() * 4]
    off = np.cumsum([0] + [len(t) for t in texts])
    events = ctw._deep_events(np.frombuffer(b"".join(texts), np.uint8), off)
    flat = [bytes([0xFF] * 6) + t + b"\xff" for t in texts]
    want = [(t[k - 6 : k][::-1] + t[k : k + 1]) for t in flat for k in range(6, len(t))]
    assert [int(e).to_bytes(7, "big") for e in events] == want
    counts = Counter(want)
    contexts = sorted({w[:6] for w in want} | {b"zzzzzz", want[3][:5] + b"z"})
    cells = np.array(sorted(int.from_bytes(c + bytes([x]), "big") for c in contexts for x in range(256)), np.uint64)
    q = {x: (x % 5 + 1) / sum(y % 5 + 1 for y in range(256)) for x in range(256)}
    prior = np.array([q[int(c) & 255] for c in cells])
    got = ctw.deep_predict(cells, np.array([counts[int(c).to_bytes(7, "big")] for c in cells], float), prior)
    assert np.allclose(got.reshape(-1, 256).sum(axis=1), 1)

    def node(ctx):
        c = Counter()
        for w, k in counts.items():
            if w.startswith(ctx):
                c[w[6]] += k
        return c

    def weighted(ctx):
        own, seen = 1.0, 0
        c = node(ctx)
        for x, k in c.items():
            for j in range(k):
                own *= (j + q[x]) / (seen + 1)
                seen += 1
        if len(ctx) == 6:
            return own, own
        below = 1.0
        for child in {w[: len(ctx) + 1] for w in counts if w.startswith(ctx)}:
            below *= weighted(child)[0]
        return 0.5 * own + 0.5 * below, own

    def predict(ctx, x, depth=4):
        c = node(ctx[:depth])
        p = (c[x] + q[x]) / (sum(c.values()) + 1)
        if depth == 6:
            return p
        total, own = weighted(ctx[:depth])
        return 0.5 * own / total * p + (1 - 0.5 * own / total) * predict(ctx, x, depth + 1)

    for k in range(0, len(cells), 97):
        raw = int(cells[k]).to_bytes(7, "big")
        assert got[k] == pytest.approx(predict(raw[:6], raw[6]), rel=1e-6)


def test_context_tree_grows_beyond_byte_classes(spark):
    """Digits share a class and so did texts that differ in them only; a model
    of real bytes learns which follows which."""
    rows = [(i, " ".join(str((i + k) % 10) * 7 for k in range(60)), "s", "b") for i in range(60)]
    held = [r.bits_per_byte for r in ctw.score(frame(spark, rows), block_bytes=6_000).filter("held_out").collect()]
    assert len(held) > 3 and max(held) < 0.7


def test_context_tree_beats_uniform_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r.bits_per_byte for r in ctw.score(docs).filter("held_out and n_bytes > 500").collect()]
    assert np.median(held) < 3.5


def test_chunks_resist_insertions():
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 123) for _ in range(20_000))
    a, b = np.frombuffer(text, np.uint8), np.frombuffer(text[:5000] + b"INSERTED" + text[5000:], np.uint8)
    one = {text[x:y] for x, y in zip([0, *chunk_dedup.cuts(a)], chunk_dedup.cuts(a))}
    two = {b.tobytes()[x:y] for x, y in zip([0, *chunk_dedup.cuts(b)], chunk_dedup.cuts(b))}
    assert len(two - one) <= 4
    h, slow = chunk_dedup.gear(a), 0
    for k, byte in enumerate(text[:300]):
        slow = ((slow << 1) + int(chunk_dedup._GEAR[byte])) % 2**32
        assert slow == h[k]


def test_chunk_dedup_removes_later_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    clean = {i: " ".join(word() for _ in range(200)) for i in range(20, 30)}
    rows = [(i, f"{' '.join(word() for _ in range(50))} {passage} {' '.join(word() for _ in range(50))}") for i in range(10)]
    rows += list(clean.items()) + [(40, None), (41, "")]
    for block_bytes in (3_000, 1 << 22):
        got = {r.doc_id: r for r in chunk_dedup.chunk_dedup(frame(spark, [(*r, "s", "b") for r in rows]), block_bytes=block_bytes).collect()}
        assert len(got) == len(rows) and got[0].n_removed == 0
        assert all(got[i].n_removed > 200 for i in range(1, 10))
        assert all(got[i].n_removed == 0 and got[i].kept_text == t for i, t in clean.items())
        assert got[40].n_bytes == got[41].n_bytes == 0
    own = frame(spark, [(1, f"{passage} and {passage}", "s", "b"), (2, clean[20], "s", "b")])
    assert [r.n_removed > 0 for r in chunk_dedup.chunk_dedup(own, within=False).orderBy("doc_id").collect()] == [False, False]
    assert [r.n_removed > 300 for r in chunk_dedup.chunk_dedup(own).orderBy("doc_id").collect()] == [True, False]
    assert [r.n_removed > 0 for r in chunk_dedup.chunk_dedup(own, within=True).orderBy("doc_id").collect()] == [True, False]


def test_chunk_dedup_catches_passages_over_fifty_words(spark):
    """Passages of 51 words, each once in an earlier document and once, between
    other words, in a later one: nearly all go, and with nearly all bytes."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 10))) for _ in range(n))
    passages = [text(51) for _ in range(400)]
    rows = [(k, f"{text(40)} {p} {text(40)}") for k, p in enumerate(passages)] + [(400 + k, f"{text(40)} {p} {text(40)}") for k, p in enumerate(passages)]
    for block_bytes in (60_000, 1 << 22):
        got = {r.doc_id: r for r in chunk_dedup.chunk_dedup(frame(spark, [(*r, "s", "b") for r in rows]), block_bytes=block_bytes).collect()}
        assert all(got[k].n_removed == 0 for k in range(400))
        share = [got[400 + k].n_removed / len(p) for k, p in enumerate(passages)]
        assert sum(x > 0.99 for x in share) >= 396 and np.mean(share) > 0.99
        assert all(len(p) <= got[400 + k].n_removed <= len(p) + 12 for k, p in enumerate(passages) if share[k])


def slow_alignment(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, row[j] - 1))
        best, prev = max(best, *row), row
    return best


def test_smith_waterman_equals_the_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(20):
        item, passages = rng.integers(1, 5, 12).astype(np.uint64), rng.integers(1, 5, (7, 30)).astype(np.uint64)
        best, _ = decontaminate.smith_waterman(item, passages)
        assert best.tolist() == [slow_alignment(item.tolist(), p.tolist()) for p in passages]


def test_decontamination_finds_copies_and_edits(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(30)) for k in range(8)] + [(8, None), (9, ""), (10, "two words")]
    edited = items[3][1].split()
    for k in (4, 11, 19, 25):
        edited[k] = "changed"
    del edited[8]
    rows = [(0, text(300)), (1, f"{text(60)} {items[0][1].upper()} {text(60)}"), (2, f"{text(40)}, {' '.join(edited)}; {text(80)}")]
    rows += [(3, None), (4, ""), (5, items[5][1].replace(" ", "\n")), (6, text(3000) + " " + items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(*r, "s", "b") for r in rows])
    for shard in (decontaminate.SHARD_BYTES, 300):
        got = decontaminate.contaminated(docs, bench, shard_bytes=shard).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (2, 3), (5, 5), (6, 6)]
        by = {r.doc_id: r for r in got}
        assert by[1].score == 1 and 0.6 < by[2].score < 0.9
        assert rows[1][1][by[1].start : by[1].end] == items[0][1].upper()
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [0, 3, 4]
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == []


def test_decontamination_finds_every_edit_beside_exact_copies(spark):
    """Every text that shares three words in a row with an item and scores 0.5
    or more, with the score of the whole text's alignment, though the exact
    copies make the edited one's n-grams the item's commonest."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(rng.choice((20, 39))) for _ in range(120)]
    rows = []
    for item in items:
        edited = []
        for w in item:
            u = rng.random()
            edited += [w] if u > 0.3 else text(1) if u > 0.05 else [] if u > 0.02 else [w, *text(5)]
        rows += [text(30) + item + text(30), text(30) + edited + text(30)]
    grams = lambda t: {tuple(t[k : k + 3]) for k in range(len(t) - 2)}
    seeds = [grams(t) for t in items]
    want = {}
    for d, row in enumerate(rows):
        own = grams(row)
        for k, item in enumerate(items):
            if own & seeds[k] and (s := slow_alignment(item, row) / (2 * len(item))) >= 0.5:
                want[d, k] = s
    docs = frame(spark, [(d, " ".join(r), "s", "b") for d, r in enumerate(rows)])
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(want) > 160 and got == want


def test_hit_pairs_come_in_parts_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(3)
    seeds = decontaminate.Seeds(rng.integers(1, 4, 40).astype(np.uint64), np.array([0, 2, 20, 40]), 3)
    h, first = rng.integers(1, 4, 200).astype(np.uint64), np.array([0, 50, 52, 120, 200])
    (whole,) = seeds.pairs(h, first)
    for most in (1, 50, 500):
        monkeypatch.setattr(decontaminate, "PAIRS", most)
        parts = list(seeds.pairs(h, first))
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts), whole))
        assert all(a[1][-1] < b[1][0] for a, b in zip(parts, parts[1:]))
    assert len(list(seeds.pairs(h[:0], np.array([0])))) == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "123 ... 45", "fr"), (10**6 + 3, "été", None)], docs.schema)
    got = langid.identify(docs.union(extra)).join(docs.union(extra), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang and r.text and len(r.text) > 40]
    assert len(held) > 150
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    odd = {r.doc_id: r for r in got if r.doc_id >= 10**6}
    assert [odd[10**6 + k].lang_pred == "und" for k in range(4)] == [True, True, True, False]
    assert all(0 <= r.score <= 1 and r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    nothing = langid.identify(docs.limit(5).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert all(r.lang_pred == "und" for r in nothing)
    assert langid.identify(docs.limit(0)).collect() == []


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffix_dedup.suffix_dedup(none).collect() == []
    assert chunk_dedup.chunk_dedup(none).collect() == []
    assert minhash.near_duplicates(none).collect() == []
    assert ctw.score(none).collect() == []


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text, "s", "b"), (3, text, "s", "b"), (3, text, "s", "b"), (5, text, "s", "b")]
    df = frame(spark, rows)
    assert sorted(len(r.spans) for r in suffix_dedup.suffix_dedup(df).collect()) == [0, 1, 1, 1]
    near = minhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in near) == [("3", 3, True), ("3", 3, True), ("5", 3, False), ("None", None, True)]
    assert len(chunk_dedup.chunk_dedup(df).collect()) == len(ctw.score(df).collect()) == len(langid.identify(df.withColumnRenamed("score", "lang")).collect()) == 4


def brute_chunks(rows, passage, within):
    """Each document's removed spans, chunk by chunk and byte by byte."""
    data = {i: (t or "").encode() for i, t in sorted(rows)}
    ends = {i: chunk_dedup.cuts(np.frombuffer(b, np.uint8)).tolist() for i, b in data.items()}
    first, out = {}, {}
    for i, b in data.items():
        for s, e in zip([0, *ends[i]], ends[i]):
            first.setdefault(b[s:e], (i, s))

    def alike(i, p, j, q, step):
        a, b, n = data[i], data[j], 0
        while n < chunk_dedup.REACH:
            x, y = (p + n, q + n) if step > 0 else (p - 1 - n, q - 1 - n)
            if min(x, y) < 0 or x >= len(a) or y >= len(b) or a[x] != b[y]:
                break
            n += 1
        return n

    for i, b in data.items():
        found, run = [], []
        for s, e in [*zip([0, *ends[i]], ends[i]), (None, None)]:
            j, at = first[b[s:e]] if s is not None else (None, None)
            if s is not None and ((j, at) != (i, s) if within else j != i):
                run.append((s, e, j, at))
            elif run:
                (s0, _, j0, at0), (s1, e1, j1, at1) = run[0], run[-1]
                found.append((s0 - alike(i, s0, j0, at0, -1), e1 + alike(i, e1, j1, at1 + e1 - s1, 1)))
                run = []
        gone = np.zeros(len(b) + 2, bool)
        for s, e in found:
            if e - s >= passage:
                gone[s + 1 : e + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        spans = []
        for s, e in zip(edges[::2], edges[1::2]):
            while s < e and b[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(b) and b[e] & 0xC0 == 0x80:
                e -= 1
            spans.append((s, e))
        out[i] = spans
    return out


@pytest.mark.parametrize(("passage", "within"), [(1, True), (1, False), (chunk_dedup.PASSAGE, True)])
def test_chunk_dedup_equals_brute_force(spark, passage, within):
    rows = [r[:2] for r in odd_rows() if r[0] != 16] + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_chunks(rows, passage, within)
    for block_bytes in (50_000, 1 << 22):
        found = chunk_dedup.chunk_dedup(frame(spark, [(*r, "s", "b") for r in rows]), passage=passage, within=within, block_bytes=block_bytes).collect()
        assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in found} == want
    assert sum(len(s) > 0 for s in want.values()) > 20


def test_kernel_equals_sets_of_ngrams():
    """The batched products are the kernel by definition: shared n-grams over
    the geometric mean of the set sizes, within the model's n-grams."""
    import pyarrow as pa

    texts = ["The cat sat", "le chat est là", "", "der hund und die katze 12", "THE  cat\tsat 9", "x"]
    model = langid.fit(texts[:2] + texts[3:5], ["en", "fr", "de", "en"], landmarks=4)

    def grams(text):
        raw = re.sub(rb"[0-9]", b"0", re.sub(rb"[\t\n\x0b\x0c\r ]", b" ", text.encode())).lower()
        return {langid._BASE[n] + int.from_bytes(raw[i : i + n], "big") for n in langid.SIZES for i in range(len(raw) - n + 1)}

    own = set(model.grams.tolist())
    marks = [grams(texts[i]) & own for i in (0, 1, 3, 4)]
    buf, off = tb.column(pa.array(texts))
    got = langid._kernel(langid._presence(langid._FOLD[buf], off, model.grams, langid._lookup(model.grams)), model.landmarks)
    want = {tuple(sorted(m)): [len(m & grams(t)) / max(1, (len(m) * len(own & grams(t)))) ** 0.5 for t in texts] for m in marks}
    assert np.allclose(sorted(got.T.tolist()), sorted(want[tuple(sorted(m))] for m in marks), atol=1e-5)


def test_two_step_exchange_gives_the_same_rows(spark):
    """Beyond ``fan`` receivers, messages are packed and sorted in between."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = frame(spark, [(1000 + r[0], *r[1:]) for r in odd_rows()]).select("doc_id", "text")
    docs = docs.union(odd).union(spark.createDataFrame([(None, "null id " * 30)], docs.schema))
    for op, size in ((suffix_dedup.suffix_dedup, 40_000), (chunk_dedup.chunk_dedup, 40_000), (ctw.score, 60_000)):
        one, two = (sorted(map(str, op(docs, block_bytes=size, fan=fan).collect())) for fan in (2048, 2))
        assert one == two and len(one) == docs.count()
