"""Language identification with a linear-chain conditional random field.

Every word of a text has a hidden language. A word's features are its prefixes and suffixes, its
character n-grams and, where it was frequent in training, itself (the lexicon); neighbouring words are
tied by learned transitions. Forward-backward gives each word's language posterior, so code-switched
passages are labelled word by word; a document's language is the one with the largest sum of
posteriors, and its score is that sum's share.

Training fits emissions and transitions by gradient ascent on the log-likelihood of chains of words
of a bounded sample of labelled documents. Labels name whole documents, so each chain carries its
document's language; to learn transitions between languages, chains are joined end to end across
documents with the chance ``SWITCH``.

Prediction is one pass over all texts, each whole. The chain runs in blocks of ``BLOCK`` words: products
of the transfer matrices of all blocks at once, then a short scan over a text's blocks, then forward and
backward inside all blocks at once. This is the exact chain, not an approximation at block ends.

Nulls and edges: a null text, or one without a letter, is ``und`` with score 0; words without letters
carry no evidence but keep the chain going; null languages are not trained on; without labelled rows
every text is ``und``. Repeated rows are judged alike, extra columns are ignored, an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import fold

FOLDS = 4
HELD = 2
UNKNOWN = "und"
#: Bound on the labelled documents of each language that are sampled, and on the words used of all.
TRAINING_DOCS = 300
#: Characters of a sampled document that training reads; predictions read whole texts.
TRAINING_CHARS = 20_000
TRAINING_WORDS = 200_000
HASHES = 1 << 16
AFFIX = 3
NGRAM = 3
LEXICON = 2_000
CHAIN = 24
SWITCH = 0.1
BLOCK = 32
EPOCHS = 3
BATCH = 256
RATE = 0.05
L2 = 1e-5
SEED = 13
#: Characters of texts that a task labels at once; their words times the languages are its arrays.
PORTION = 500_000
#: Distinct words that a task remembers the emissions of.
KNOWN_WORDS = 400_000

LETTERS = re.compile(r"[^\W\d_]+")


class Hashed(dict):
    """The number of each feature name, hashed when first asked for."""

    def __missing__(self, name: str) -> int:
        self[name] = number = zlib.crc32(name.encode("utf-8", "replace")) % HASHES
        return number


def letters_of(word: str) -> str:
    """A word's letters, lower-cased; what its features are made of."""
    lowered = word.lower()
    return lowered if lowered.isalpha() else "".join(LETTERS.findall(lowered))


def letter_features(letters: str, lexicon: dict[str, int], hashed: Hashed) -> list[int]:
    """Numbers of the features of a word's letters: affixes, n-grams and the word itself."""
    if len(hashed) > HASHES:
        hashed.clear()
    n = len(letters)
    names = [f"p{letters[:k]}" for k in range(1, min(AFFIX, n) + 1)]
    names += [f"s{letters[n - k :]}" for k in range(1, min(AFFIX, n) + 1)]
    names += {letters[k : k + NGRAM] for k in range(n - NGRAM + 1)}
    found = [hashed[name] for name in names]
    return [*found, HASHES + lexicon[letters]] if letters in lexicon else found


@dataclass
class Crf:
    """``emission`` has a row a feature and a column a language; ``transition[a, b]`` scores a then b."""

    languages: list[str]
    lexicon: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray


class Known:
    """Emissions of the words of earlier texts: each word's row in one growing table."""

    def __init__(self, crf: Crf):
        self.crf, self.hashed, self.row = crf, Hashed(), {}
        self.table = np.zeros((1, len(crf.languages)), np.float32)  # row 0: a word without letters
        self.rows = 1

    def learn(self, words: set[str]) -> None:
        cores = {word: letters_of(word) for word in words}
        parts = [c for c in {*cores.values()} if c and c not in self.row]
        if parts:
            lists = [letter_features(c, self.crf.lexicon, self.hashed) for c in parts]
            starts = np.cumsum([0, *map(len, lists[:-1])])
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64)
            found = np.add.reduceat(self.crf.emission[flat], starts, axis=0)
            after = self.rows + len(parts)
            if after > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(after, 65536), found.shape[1]), np.float32)])
            self.table[self.rows : after] = found
            self.row.update(zip(parts, range(self.rows, after), strict=True))
            self.rows = after
        self.row.update((word, self.row[core] if core else 0) for word, core in cores.items())

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of emissions for each word; the table starts anew when it holds too many."""
        if len(self.row) > KNOWN_WORDS:
            self.row, self.rows = {}, 1
        if missing := {w for w in words if w not in self.row}:
            self.learn(missing)
        return self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].astype(float)


def _forward_backward(potential: np.ndarray, transfer: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Scaled messages of many chains at once: ``potential`` is (chains, words, languages)."""
    ahead, back = np.empty_like(potential), np.empty_like(potential)
    message = start
    for t in range(potential.shape[1]):
        message = (message if t == 0 else message @ transfer) * potential[:, t]
        message = message / message.sum(axis=1, keepdims=True)
        ahead[:, t] = message
    message = end
    for t in range(potential.shape[1] - 1, -1, -1):
        back[:, t] = message
        message = (message * potential[:, t]) @ transfer.T
        message = message / message.sum(axis=1, keepdims=True)
    return ahead, back


def posteriors(scores: np.ndarray, starts: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Language posteriors of each word of many texts.

    ``scores`` has the emissions of all words, text after text; ``starts`` is where each text begins. Texts
    are padded to whole blocks with words that neither emit nor switch.
    """
    n, k = scores.shape
    sizes = np.diff(np.r_[starts, n])
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = first[text] * BLOCK + np.arange(n) - starts[text]
    total = int(blocks.sum())
    potential = np.ones((total * BLOCK, k))
    potential[place] = np.exp(scores - scores.max(axis=1, keepdims=True))
    potential = potential.reshape(total, BLOCK, k)
    real = np.zeros(total * BLOCK, dtype=bool)
    real[place] = True
    real = real.reshape(total, BLOCK)
    transfer = np.exp(transition - transition.max())
    transfer = transfer / transfer.sum()
    opens = np.zeros(total, dtype=bool)
    opens[first[blocks > 0]] = True

    # What a block does to a message that comes in from the left (from the right: transposed).
    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(BLOCK):
        step = transfer[None] * potential[:, t][:, None, :]
        if t == 0:
            step = np.where(opens[:, None, None], np.eye(k) * potential[:, 0][:, None, :], step)
        moved = product @ step
        product = np.where(real[:, t][:, None, None], moved, product)
        product /= product.sum(axis=(1, 2), keepdims=True)

    # Messages at the blocks' ends, one step a block of the longest text, all texts at once.
    enter, leave = np.ones((total, k)), np.ones((total, k))
    for b in range(int(blocks.max(initial=0))):
        at = first[blocks > b] + b
        if b:
            enter[at] = np.einsum("nk,nkl->nl", enter[at - 1], product[at - 1])
        enter[at] /= enter[at].sum(axis=1, keepdims=True)
    for b in range(int(blocks.max(initial=0)) - 1, -1, -1):
        at = first[blocks > b + 1] + b
        leave[at] = np.einsum("nk,nlk->nl", leave[at + 1], product[at + 1])
        leave[at] /= leave[at].sum(axis=1, keepdims=True)

    ahead, back = np.empty((total, BLOCK, k)), np.empty((total, BLOCK, k))
    message = enter
    for t in range(BLOCK):
        carried = np.where(opens[:, None], message, message @ transfer) if t == 0 else message @ transfer
        moved = carried * potential[:, t]
        message = np.where(real[:, t][:, None], moved / moved.sum(axis=1, keepdims=True), message)
        ahead[:, t] = message
    message = leave
    for t in range(BLOCK - 1, -1, -1):
        back[:, t] = message
        moved = (message * potential[:, t]) @ transfer.T
        message = np.where(real[:, t][:, None], moved / moved.sum(axis=1, keepdims=True), message)
    joint = (ahead * back).reshape(-1, k)[place]
    return joint / joint.sum(axis=1, keepdims=True)


def fitted(texts: list[tuple[str, str]], languages: list[str]) -> Crf:
    """A field fitted to labelled texts, by Adam on chains of ``CHAIN`` words."""
    rng, k = np.random.default_rng(SEED), len(languages)
    of = {name: number for number, name in enumerate(languages)}
    words = [(w, of[lang]) for text, lang in texts for w in text.split()]
    seen = Counter(letters_of(w) for w, _ in words)
    frequent = sorted((w for w in seen if w), key=lambda w: (-seen[w], w))[:LEXICON]
    lexicon = {w: number for number, w in enumerate(frequent)}
    pieces = [words[at : at + CHAIN // 2] for at in range(0, len(words) - CHAIN // 2 + 1, CHAIN // 2)]
    if not pieces:
        pieces = [(words * CHAIN)[: CHAIN // 2]]
    pieces = [pieces[p] for p in rng.permutation(len(pieces))[: TRAINING_WORDS * 2 // CHAIN]]
    chains = []
    for number, piece in enumerate(pieces):
        other = pieces[rng.integers(len(pieces))] if rng.random() < SWITCH else piece
        chains.append(piece + other if number % 2 else other + piece)
    hashed = Hashed()
    known = {w: letter_features(letters_of(w), lexicon, hashed) for w in {w for row in chains for w, _ in row}}
    size = HASHES + len(lexicon)
    theta = np.zeros((size + k, k))
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    eye = np.eye(k)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for begin in range(0, len(chains), BATCH):
            batch = [chains[c] for c in order[begin : begin + BATCH]]
            lists = [known[w] for row in batch for w, _ in row]
            counts = np.array([len(x) for x in lists])
            flat = np.fromiter((f for x in lists for f in x), dtype=np.int64, count=int(counts.sum()))
            word = np.repeat(np.arange(len(lists)), counts)
            scores = np.stack(
                [np.bincount(word, weights=theta[flat, c], minlength=len(lists)) for c in range(k)], axis=1
            )
            gold = np.array([lang for row in batch for _, lang in row])
            potential = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(len(batch), CHAIN, k)
            transfer = np.exp(theta[size:] - theta[size:].max())
            ones = np.ones((len(batch), k))
            ahead, back = _forward_backward(potential, transfer, ones, ones)
            node = ahead * back
            node /= node.sum(axis=2, keepdims=True)
            pair = ahead[:, :-1, :, None] * transfer * (potential * back)[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            truth = gold.reshape(len(batch), CHAIN)
            gradient = np.zeros_like(theta)
            excess = (node.reshape(-1, k) - eye[gold]) / len(gold)
            for c in range(k):
                gradient[:size, c] = np.bincount(flat, weights=excess[word, c], minlength=size)
            moves = eye[truth[:, :-1]][:, :, :, None] * eye[truth[:, 1:]][:, :, None, :]
            gradient[size:] = (pair - moves).sum(axis=(0, 1)) / len(gold)
            gradient += L2 * theta
            step += 1
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(languages, lexicon, theta[:size].astype(np.float32), theta[size:])


def training_rows(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """``(text, lang)`` to learn from, out of labelled rows outside the held-out fold, and the languages there are.

    Each language gives at most ``TRAINING_DOCS`` documents of ``TRAINING_CHARS`` characters, drawn by a hash of id and
    text, so that copies of a text weigh as they occur and a frequent language takes nothing from a rare one.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(key, FOLDS) != HELD))
    rows = rows.select("lang", "text", F.xxhash64(key, "text", F.lit(SEED)).alias("_draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    million = 1_000_000
    # Twice as many as are wanted come past this hash; the rest need no sorting.
    share = lambda n: int(min(1.0, 2 * TRAINING_DOCS / n) * million) + 1
    shares = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(share(n)))))
    likely = rows.where(F.pmod(F.col("_draw"), F.lit(million)) < shares[F.col("lang")]) if sizes else rows
    texts = likely.select("lang", F.substring("text", 1, TRAINING_CHARS).alias("text"), F.xxhash64("_draw").alias("_draw"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_draw", "text"))
    sample = texts.withColumn("_at", first).where(F.col("_at") <= TRAINING_DOCS)
    return sample.orderBy("_draw", "lang", "text").select("text", "lang"), sorted(sizes)


def trained(docs: DataFrame, key: str = "doc_id") -> Crf | None:
    """A field from ``training_rows``; None without any."""
    rows, languages = training_rows(docs, key)
    texts = [(r["text"], r["lang"]) for r in rows.collect()] if languages else []
    return fitted(texts, languages) if texts else None


def document_languages(
    texts: list[str | None], crf: Crf, known: Known
) -> list[tuple[str, float]]:
    """Language and score of each text; ``known`` remembers words between calls."""
    words, starts, owners, out = [], [], [], [(UNKNOWN, 0.0)] * len(texts)
    for number, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            starts.append(len(words))
            owners.append(number)
            words += text.split()
    if not words:
        return out
    scores = known.scores(words)
    mass = np.add.reduceat(posteriors(scores, np.array(starts), crf.transition), starts, axis=0)
    share = mass / mass.sum(axis=1, keepdims=True)
    for number, best, row in zip(owners, share.argmax(axis=1), share, strict=True):
        out[number] = (crf.languages[best], float(min(1.0, row[best])))
    return out


def portions(lengths: list[int | None], most: int = PORTION) -> Iterator[tuple[int, int]]:
    """``(start, rows)`` of consecutive rows with at most ``most`` characters together, or one longer row."""
    start, held = 0, 0
    for at, length in enumerate(lengths):
        if at > start and held + (length or 0) > most:
            yield start, at - start
            start, held = at, 0
        held += length or 0
    if len(lengths) > start:
        yield start, len(lengths) - start


def predicted(docs: DataFrame, crf: Crf | None, key: str = "doc_id") -> DataFrame:
    """``(key, lang_pred, score)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(crf) if crf else None
        for batch in batches:
            for at, rows in portions(pc.utf8_length(batch.column(1)).to_pylist()):
                piece = batch.slice(at, rows)
                texts = piece.column(1).to_pylist()
                found = document_languages(texts, crf, known) if crf else [(UNKNOWN, 0.0)] * len(texts)
                columns = [piece.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "lang_pred", "score"])

    of_key = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text").alias("_text")).mapInArrow(
        run, f"`{key}` {of_key}, lang_pred string, score double"
    )


def identified(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, held_out, lang_pred, score)`` of every document."""
    found = predicted(docs, trained(docs, key), key)
    return found.select(key, (fold(key, FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
