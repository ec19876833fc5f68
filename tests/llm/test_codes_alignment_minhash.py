import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from kinfold.llm import alignment, minhash, vector_codes
from kinfold.llm.common import materialize

# --- vector codes ---------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Plain numbers: rows of (id, vector, label)."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], g) for i, v, g in rows]
    width = max(len(v) for _, v, _ in kept)
    width = max(1, -(-width // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), g) for i, v, g in kept]
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]

    def nearest(part, book):
        far = [sum((x - y) ** 2 for x, y in zip(part, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[nearest(cut(v, p), books[p])[0]].append(cut(v, p))
            books[p] = [
                tuple(sum(xs) // len(held[e]) for xs in zip(*held[e], strict=True)) if held[e] else entry
                for e, entry in enumerate(books[p])
            ]
    out, by_label = [], Counter()
    for i, v, g in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(e for _, e in found)
        by_label[g] += error
        out.append((i, "".join(f"{c:02x}" for c, _ in found), error, g))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, c, e, by_label[g], digest) for i, c, e, g in out), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, code string"


def codes(spark, rows):
    table = spark.createDataFrame([(i, v, g, "x") for i, v, g in rows], VECTORS)
    return sorted((tuple(r) for r in vector_codes.compressed(table).collect()), key=repr)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_codes_equal_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    draw = np.random.default_rng(4)
    rows = [(k, (np.round(draw.normal(size=48), 1) * scale).tolist(), k % 3 or None) for k in range(90)]
    rows += [(1000 + k, rows[5][1], 1) for k in range(40)]  # a hot vector
    rows += [(7, rows[7][1], 2), (None, rows[9][1], 2)]
    assert codes(spark, rows) == brute_codes(rows)


def test_codes_of_huge_numbers_and_odd_sizes(spark):
    rows = [(1, [1e13, -1e13, 0.5], 1), (2, [1.5e13], 1), (3, [], None), (4, [0.1] * 17, None)]
    got = codes(spark, rows)
    assert got == brute_codes(rows) and [r[2] for r in got] == [0, 0, 0, 0]
    # Beyond the stated limit numbers count as the limit; an error that no long holds is the largest.
    far = [(k, [float(k)] * 16, 1) for k in range(64)] + [(64, [1e300] * 16, 1), (65, [-1e300] * 16, 2)]
    assert {r[2] for r in codes(spark, far) if r[0] >= 64} <= {0, (1 << 63) - 1}


def test_codes_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, [1.0, 2.0], 2)]
    assert [r[:4] for r in codes(spark, rows)] == [(5, "00" * 16, 0, 0)]
    assert codes(spark, rows[:4]) == [] and codes(spark, []) == []


def test_trie_shares_prefixes():
    parts = np.array([[0, 1], [0, 2], [3, 1], [3, 1 << 20]])
    trie = vector_codes.Trie(parts)
    assert [len(f) for f in trie.firsts] == [1, 2, 4]
    code, error = trie.nearest(np.array([[0, 0], [3, 1], [0, 0]]))
    assert code.tolist() == [0, 0, 1, 1] and error.tolist() == [1, 4, 0, ((1 << 20) - 1) ** 2]


# --- alignment ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def json_tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def pieces():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(texts, json_tokenizer, pieces):
    """By the definition: token ends, groups and links of every document, from the other library."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}

    def a_bytes(k):
        return bytes(byte_of[c] for c in json_tokenizer.id_to_token(k))

    def b_bytes(k):
        piece = pieces.id_to_piece(k)
        hexed = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()

    rows, held = [], Counter()
    for text in texts:
        a = json_tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        spoken = [b"".join(map(f, ids)) for f, ids in ((a_bytes, a), (b_bytes, b))]
        if not text or set(spoken) != {(" " + text).encode()}:
            rows.append(None)
            continue
        ends = []
        for f, ids in ((a_bytes, a), (b_bytes, b)):
            at, found = 0, []
            for k in ids:
                at += len(f(k))
                found.append(at)
            ends.append(found)
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for end in shared:
            groups.append(tuple([k for k, e in zip(ids, es, strict=True) if low < e <= end]
                                for ids, es in ((a, ends[0]), (b, ends[1]))))
            low = end
        links = [(x, y) for left, right in groups for x in left for y in right]
        held.update(set(links))
        rows.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(held[x] == most[x[0]] for x in links)
        out.append((n_a, n_b, len(groups), len(links), best, sum(held[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = ["Hello  world\nnew\t line", "café 你好 \U0001f600!", "ﬁne ▁ mark", "<|endoftext|> a</s>", " ",
       "x", None, "", "123456789 0.5e-7", "don't  we'll\n\n\n  it's", "zzzzzzzzqqqqqq" * 30, "\u0000\u0001 nul", "é combining"]


@pytest.mark.parametrize("size", [1_000_000, 2_000])
def test_alignment_equals_brute_force(docs, small, json_tokenizer, pieces, size):
    texts = ODD + [r["text"] for r in small.limit(15).collect()] + ["the same text"] * 30
    want = brute_alignment(texts, json_tokenizer, pieces)
    rows = materialize(alignment.aligned(docs(texts).coalesce(2)), "aligned")
    counts = alignment.pair_counts(rows, alignment.pieces_of())
    found = alignment.weighed(rows, counts, size)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
           for r in found.collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_windows_join_to_the_whole():
    own = alignment.Aligner(public_tokenizers.path(alignment.BYTE_RANKS), public_tokenizers.path(alignment.PIECES))
    a, b = own.encoded("some words, and more words: " * 20)
    n_groups, windows = own.windows(a, b)
    assert n_groups >= len(windows) > 50 and len(own.known) < 12
    sides = [[], []]
    for window in windows:
        for group in window:
            for side, ids in zip(sides, group.text.split("|"), strict=True):
                side += map(int, ids.split(","))
    assert sides == [a.tolist(), b.tolist()]


def test_alignment_edges(spark, docs):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    empty = alignment.alignments(docs([]))
    assert empty.columns == names and empty.count() == 0
    extra = docs([(None, "a b", "en", "s"), (3, None, None, None)]).selectExpr("*", "1 AS pairs", "2 AS times", "3 AS n")
    rows = {r["doc_id"]: tuple(r)[1:] for r in alignment.alignments(extra).collect()}
    assert rows[3] == (0, 0, 0, 0, 0, 0, "") and rows[None][:4] == (2, 2, 2, 2)
    long = alignment.alignments(docs(["word and " * 300_000, "é" * 20_000])).collect()
    assert max(r["n_groups"] for r in long) > 500_000


# --- MinHash --------------------------------------------------------------------------------------


def brute_components(rows, size=3, percent=85):
    def shingles(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        if len(words) < size:
            return {" ".join(words)} if words else set()
        return {" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}

    sets = [(i, shingles(t)) for i, t in rows]
    label = {k: k for k in range(len(sets))}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for p, (_, a) in enumerate(sets):
        for q in range(p):
            b = sets[q][1]
            if a and 100 * len(a & b) >= percent * len(a | b):
                label[max(top(p), top(q))] = min(top(p), top(q))
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[top(k)].append(i)
    return {(i, len(s), min(low[top(k)])) for k, (i, s) in enumerate(sets)}


def edited(words, rng, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("list_rows, chunk", [(256, 512), (2, 5)])
def test_minhash_components_equal_brute_force(docs, small, list_rows, chunk):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    base, long = [word() for _ in range(150)], [word() for _ in range(900)]
    texts = [edited(base, rng, rng.randrange(8)) for _ in range(60)]  # near copies around the threshold
    texts += [edited(long, rng, rng.randrange(60)) for _ in range(30)]  # sketches that hold a part only
    texts += [" ".join(base)] * 20 + [" ".join(base).upper().replace(" ", "\n ")]
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(5, 120))]) for _ in range(40)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts += ["a b", "A  b", "a", "", None, " \t", "", "x y z", "x y z x y z", "z x y z x y"]
    rows = list(enumerate(texts)) + [(r["doc_id"] + 1000, r["text"]) for r in small.collect()]
    rng.shuffle(rows)
    table = docs([(i, t, "en", "s") for i, t in rows])
    got = minhash.components(table, list_rows=list_rows, chunk=chunk).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    assert len(got) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_least_overlap_holds():
    rng = np.random.default_rng(1)
    for size in (10, 54, 60, 75, 200, 3000):
        least = minhash.least_overlap(size)
        union = size * 100 // 85
        shared = -(-85 * union // 100)
        for _ in range(2000):
            order = rng.permutation(union)[: minhash.LISTED]
            assert (order < shared).sum() >= min(least, shared)


def test_minhash_edges(spark, docs):
    assert minhash.components(docs([])).count() == 0
    rows = [(None, "a b c d", "en", "s"), (5, "a b c d", "en", "s"), (None, "q r s t", None, None), (5, "a b c d", "en", "s"),
            (None, None, None, None), (9, None, "x", "y")]
    table = docs(rows).selectExpr("*", "1 AS node", "2 AS n", "3 AS term", "4 AS component", "5 AS first")
    got = sorted((tuple(r) for r in minhash.components(table).collect()), key=repr)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (None, 2, None, True), (5, 2, 5, True),
                          (None, 0, None, True), (9, 0, 9, True)], key=repr)
