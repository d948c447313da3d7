"""Conversation tries, whitening and lattice likelihoods against brute force, with every odd case."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
from lattiq.llm import lattice, prefix_trie, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in BLANK:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


# ------------------------------------------------------------------------------------------------------------ tries


def brute_trie(rows):
    """rows: (conv_id, turn, role, text), turns of a conversation all different. Every prefix of every conversation, counted by itself."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = set()
    for node, ids in members.items():
        below = [u for u in members if u[: len(node)] == node]
        saved = sum((len(members[u]) - 1) * (len(words_of(u[-1][1])) if u else 0) for u in below)
        ends = ",".join(map(str, sorted(c for c in ids if full[c] == node)))
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), sum(not children[u] for u in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n=130, hot=40):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        k = rng.choice([1, 1, 2, 3, 5, 9])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hello there", "hello", "  two\twords ", "a b c d", ""])) for t in range(k)]
    for c in range(1000, 1000 + hot):  # copies, beyond a list piece of ids
        rows += [(c * 7001, t, "user", f"same {t}") for t in range(5)]
    rows += [(77001, None, "user", "null turn first"), (77001, 0, None, None), (77001, 1, "user", "x")]
    rows += [(88002, t, "user", f"long {t % 7}") for t in range(300)] + [(88004, t, "user", f"long {t % 7}") for t in range(290)]
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("part_rows", [3, 40, 10**6])
def test_trie_equals_brute_force(spark, part_rows):
    rows = conversations(part_rows % 7)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(5) for c in ("id", "depth", "key", "w", "h", "n", "pid", "edge", "turns")})
    assert trie_rows(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df)), part_rows)) == brute_trie(rows)


def test_trie_of_turnless_and_odd_conversations(spark):
    # 21 has one turn and takes more than that from an absent opening: it is left without a turn
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(lone, 0, "user", "gone"), (100, 0, "user", "a"), (None, 0, "user", "nameless")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie_rows(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df))))
    assert got == brute_trie(rows)
    assert trie_rows(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df.limit(0))))) == set()
    twice = spark.createDataFrame([(100, 0, "user", "b c"), (100, 0, "user", "b c"), (100, 0, "user", "a")], df.schema)  # ties and repeated rows keep an order
    found = prefix_trie.trie(prefix_trie.turns(twice)).collect()
    assert sorted(r.depth for r in found) == [0, 1, 2, 3] and {r.n_convs for r in found} == {1}


def test_trie_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    from lattiq.llm.prefix_trie import op12_conversation_trie

    assert trie_rows(op12_conversation_trie(spark, SF)) == brute_trie(rows)


# ------------------------------------------------------------------------------------------------------------ whitening


def brute_whitening(rows, k=16):
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    e, vecs = np.linalg.eigh(cov)
    e, vecs = e[::-1], vecs[:, ::-1]
    out = {}
    for i, x in kept:
        dev = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        p = np.array([(n * v - s) / n for v, s in zip(x, sums, strict=True)]) @ vecs[:, :k] / np.sqrt(e[:k])
        out[i] = (n, dev, p, e[:k] / e.sum())
    return out


def vectors(seed=3, n=300, d=20):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag(np.linspace(0.2, 3, d)) @ rng.normal(size=(d, d)) + 5
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third are copies
    rows += [(2000, None), (2001, [None] + [1.0] * (d - 1)), (2002, [float("nan")] * d), (2003, [float("inf")] * d)]
    return rows


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_whitening_equals_eigenvectors(spark, partitions):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(partitions).withColumns({c: F.lit("c") for c in ("x", "n", "id", "part", "label", "v")})
    found = whitening.whiten(df, components=16).collect()
    want = brute_whitening(rows)
    assert sorted(r.vec_id for r in found) == sorted(want)
    first = found[0]
    sign = np.sign(np.array(first.whitened) * want[first.vec_id][2])
    for r in found:
        n, dev, p, explained = want[r.vec_id]
        assert r.n == n and r.deviation == dev
        np.testing.assert_allclose(np.array(r.whitened) * sign, p, rtol=1e-7, atol=1e-8)
        np.testing.assert_allclose(r.explained, explained, rtol=1e-9)
        assert 0 <= r.identity_error < 1e-9


def test_merging_loses_nothing():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (400, 12))
    parts = [whitening.summary(p) for p in np.array_split(x, [1, 3, 50, 51, 300])]
    total = parts[0]
    for p in parts[1:]:
        total = whitening.merge(total, p)
    centred = x - x.mean(0)
    assert total.n == 400 and total.sums == x.sum(0).tolist() and total.triangle.shape == (12, 12)
    np.testing.assert_allclose(total.triangle.T @ total.triangle, centred.T @ centred, rtol=1e-10, atol=1e-8)


def test_whitening_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [1.0]), (5, []), (6, [3e38, 1.0])], schema)
    rows = whitening.whiten(df).collect()  # one distinct vector: no variance at all; ragged, empty and huge vectors drop
    assert sorted((r.vec_id or 0) for r in rows) == [0, 1, 1]
    assert all(r.n == 1 and r.deviation == 0 and r.whitened == [0.0, 0.0] and r.explained == [0.0, 0.0] and r.identity_error == 0 for r in rows)
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], schema)  # rank one
    rows = whitening.whiten(flat).collect()
    assert all(abs(r.explained[0] - 1) < 1e-9 and r.whitened[1:] == [0.0, 0.0] and r.identity_error < 1e-9 for r in rows)
    assert whitening.whiten(df.limit(0)).collect() == []


def test_whitening_query(spark):
    found = whitening.op11_embedding_whitening(spark, SF)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_whitening(rows)
    got = defaultdict(dict)
    for r in found.collect():
        got[r.vec_id][r.component] = r
    assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 17)) for g in got.values())
    for i in list(want)[:50]:
        n, dev, p, explained = want[i]
        np.testing.assert_allclose(np.abs([got[i][k].whitened for k in range(1, 17)]), np.abs(p), rtol=1e-6, atol=1e-7)
        assert all(got[i][k].deviation == dev and got[i][k].n == n for k in range(1, 17))


# ------------------------------------------------------------------------------------------------------------ lattice


def spellings(pieces, word):
    """Every way to spell a word by pieces."""
    if not word:
        return [[]]
    return [[p, *rest] for p in pieces if word.startswith(p) for rest in spellings(pieces, word[len(p) :])]


LISTED = {b" a": 3.0, b" ab": 2.0, b"b": 1.0, b"ab": 4.0, b"abc": 1.0, b"c": 0.5, b" ": 1.0, b"bc": 2.0}


def table_of(vocabulary):
    """piece -> number, read back from the trie."""
    out, stack = {}, [(0, b"")]
    while stack:
        state, word = stack.pop()
        if vocabulary.piece[state] >= 0:
            out[word] = int(vocabulary.piece[state])
        for k in np.flatnonzero(vocabulary.keys // 256 == state):
            stack.append((int(vocabulary.to[k]), word + bytes([int(vocabulary.keys[k]) % 256])))
    return out


def test_all_spellings_are_summed(monkeypatch):
    import pyarrow as pa

    vocabulary = lattice.pieces(LISTED)
    number = table_of(vocabulary)
    assert set(LISTED) <= set(number) and len(number) == 256 + sum(len(p) > 1 for p in LISTED)
    log_p = np.log(vocabulary.weight)
    words = [b"ab", b"abc", b"abcabab", b"", b"b\xff", b"cab" * 3]
    counts = np.arange(1.0, len(words) + 1)
    uses = np.zeros(len(log_p))
    got = lattice._spelled(vocabulary, log_p, pa.array(words, pa.binary()), counts, uses)
    want_uses = np.zeros(len(log_p))
    for word, value, count in zip(words, got, counts, strict=True):
        ways = [(w, math.exp(sum(log_p[number[p]] for p in w))) for w in spellings(number, b" " + word)]
        total = sum(p for _, p in ways)
        assert value == pytest.approx(math.log(total), rel=1e-12)
        for w, p in ways:
            for x in w:
                want_uses[number[x]] += count * p / total
    np.testing.assert_allclose(uses, want_uses, rtol=1e-9, atol=1e-12)
    for size in (1, 3, 8):  # long words are looked at in stretches
        monkeypatch.setattr(lattice, "TOGETHER", size)
        long_uses = np.zeros(len(log_p))
        value = lattice.spell_long(vocabulary, log_p, np.frombuffer(b" abcabab", np.uint8), 3.0, long_uses)
        assert value == pytest.approx(got[2], rel=1e-12)
        again = np.zeros(len(log_p))
        lattice._spelled(vocabulary, log_p, pa.array(words, pa.binary()), counts, again)
        np.testing.assert_allclose(again, want_uses, rtol=1e-9, atol=1e-12)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_scores(rows, vocabulary, rounds):
    number = table_of(vocabulary)
    longest = max(map(len, number))
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, _) in enumerate(rows)}
    tokens = [[w.encode() for w in words_of(fold(t))] for _, t in rows]
    count = Counter(w for k, ws in enumerate(tokens) if not held[k] for w in ws)
    texts = sum(not h for h in held.values())
    n, v = sum(count.values()) + texts, len(count) + (texts > 0)

    def run(word, p):
        """Forward and backward sums in plain numbers."""
        word = b" " + word
        a = [1.0] + [0.0] * len(word)
        b = [0.0] * len(word) + [1.0]
        hits = [(s, e, number[word[s:e]]) for s in range(len(word)) for e in range(s + 1, min(len(word), s + longest) + 1) if word[s:e] in number]
        for s, e, k in sorted(hits, key=lambda x: x[1]):
            a[e] += a[s] * p[k]
        for s, e, k in sorted(hits, key=lambda x: -x[0]):
            b[s] += b[e] * p[k]
        return a[-1], [(k, a[s] * p[k] * b[e] / a[-1]) for s, e, k in hits]

    p, total = vocabulary.weight, 0.0
    for _ in range(rounds):
        uses = np.zeros(len(p))
        for w, c in count.items():
            for k, x in run(w, p)[1]:
                uses[k] += c * x
        total = uses.sum()
        if not total:
            break
        p = (uses + lattice.ADDED) / (total + lattice.ADDED * len(p))
    end = (texts + lattice.ADDED) / (texts + total + 2 * lattice.ADDED)
    p = p * (1 - end)
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    out = []
    for k, (i, _) in enumerate(rows):
        ws = tokens[k]
        out.append((i, held[k], len(ws) + 1, sum(count[w] > 0 for w in ws) + (texts > 0), n, sum(base(count[w]) for w in ws) + base(texts), sum(math.log10(run(w, p)[0]) for w in ws) + math.log10(end)))
    return out


def texts():
    rng = random.Random(4)
    some = "ab abc cab Abba bca ünder zebra a b c the".split()
    rows = [(i, " ".join(rng.choices(some, k=rng.choice([1, 5, 30])))) for i in range(60)]
    rows += [(61, "hot " * 900), (62, None), (63, ""), (64, " \t\n"), (65, "once only ☃ x\x1fy"), (None, "ab nothing"), (3, "other text of a repeated id"), (5, rows[5][1]), (1, "held-out-words-alone")]
    return rows


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


@pytest.mark.parametrize("frequent", [0.02, 2.0, 1e-9])
def test_scores_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)  # some, no and all words are looked up in the tasks
    vocabulary = lattice.pieces(LISTED)
    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("h", "n", "id", "key", "word", "score", "learn", "rest", "seen")})
    same(lattice.score(df, held(), vocabulary).collect(), brute_scores(texts(), vocabulary, lattice.ROUNDS))


def test_probabilities_sum_to_one():
    vocabulary = lattice.pieces({b"a": 1.0, b" a": 1.0})
    model = lattice.Model(vocabulary, np.log(vocabulary.weight) + math.log(0.5), math.log(0.5))
    assert np.exp(model.log_p).sum() + math.exp(model.end) == pytest.approx(1)


def test_scores_of_odd_tables(spark):
    vocabulary = lattice.pieces(LISTED)
    schema = "doc_id long, text string"
    assert lattice.score(spark.createDataFrame([], schema), held(), vocabulary).collect() == []
    apart = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(apart[0], "ab abc"), (apart[1], None)]  # nothing to learn from
    same(lattice.score(spark.createDataFrame(rows, schema), held(), vocabulary).collect(), brute_scores(rows, vocabulary, lattice.ROUNDS))
    rows = [(2, "x" * (lattice.TOGETHER + 70_000)), (3, "x y"), (4, "ab " * 500_000)]  # a word longer than a stretch, a long text
    got = {r.doc_id: r for r in lattice.score(spark.createDataFrame(rows, schema), held(), vocabulary).collect()}
    assert got[4].n_tokens == 500_001 and all(math.isfinite(r.score) and r.score < 0 for r in got.values())


def test_scoring_query(spark):
    found = lattice.op13_lm_scoring(spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in words_of(fold(t)))
    learned = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    n, v = sum(count.values()) + len(learned), len(count) + 1
    for i, t in rows:
        ws = words_of(fold(t))
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) + math.log10((len(learned) + 0.5) / (n + 0.5 * (v + 1)))
        assert (got[i].n_tokens, got[i].train_tokens, got[i].n_known) == (len(ws) + 1, n, sum(count[w] > 0 for w in ws) + 1)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score < 0
    plain = [got[i].score / got[i].n_tokens for i, t in rows if got[i].held_out and got[i].n_tokens > 50]
    assert plain and sum(plain) / len(plain) > -8  # far likelier than letters by themselves
