"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability sums over all ways to
cut it into pieces, by a forward recursion; a text's is the product over its words. Words begin with the vocabulary's
word mark. A byte that no piece covers costs ``UNKNOWN``. No piece and no word is cut or left out: words over ``SHORT``
bytes go through the same recursion a block of places at a time, with sums that are brought back to 1 every ``RESCALE``
places and a logarithm beside them.

Training: one expectation step from equal piece probabilities gives each language's expected piece counts (forward and
backward sums over all segmentations of every training word), smoothed by ``SMOOTH``. Counts of distinct words are summed
a part of the input at a time; what reaches the driver is languages x vocabulary, whatever the corpus.

The posterior over languages (equal priors) of the whole text gives the prediction; equal scores go to the least language.
``und`` with score 0 is the answer for null text, text without a letter, and where nothing was learned. Rows are answered
each by its own text, so null and repeated ids, repeated rows and other columns of any name make no difference; an empty
table has no answers. A text is read whole; what is held are numbers of its distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import tokens

SHORT, BLOCK, RESCALE, SMOOTH, UNKNOWN = 48, 4096, 16, 0.05, -18.0
#: Sums are kept times exp(LIFT) a byte: between exp(-LIFT) and exp(LIFT) a byte, which a float holds over a short word.
LIFT = -UNKNOWN / 2
MARK = "▁".encode()
U8 = np.uint64
_TABLE_BITS, _CACHE_BITS = 18, 21


def pieces(path: str | None = None) -> list[bytes]:
    """The vocabulary's plain pieces (the word mark is a space), in its order."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            out.append(model.id_to_piece(i).encode().replace(MARK, b" "))
    return list(dict.fromkeys(out))


class Vocabulary:
    """Finds pieces by hash: a bitmap turns most strings away, an open table names the rest."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.size, self.longest = len(vocabulary), max(map(len, vocabulary), default=1)
        self.lift = np.exp(LIFT * np.array([len(p) for p in vocabulary], float))[:, None]
        self.keys = np.zeros(1 << _TABLE_BITS, U8)
        self.ids = np.full(1 << _TABLE_BITS, -1, np.int32)
        self.seen = np.zeros(1 << 21, bool)
        self.probes = 1
        for i, name in enumerate(map(_hash, vocabulary)):
            self.seen[name >> 43] = True
            step = 0
            while self.ids[at := (name + step) & ((1 << _TABLE_BITS) - 1)] >= 0:
                step += 1
            self.keys[at], self.ids[at] = name, i
            self.probes = max(self.probes, step + 1)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the names that are pieces, and the pieces' numbers."""
        maybe = np.flatnonzero(self.seen[(names >> U8(43)).astype(np.int64)])
        names = names[maybe]
        at = (names & U8((1 << _TABLE_BITS) - 1)).astype(np.int64)
        out = np.where(self.keys[at] == names, self.ids[at], -1)
        for step in range(1, self.probes):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            more = (at[left] + step) & ((1 << _TABLE_BITS) - 1)
            out[left] = np.where(self.keys[more] == names[left], self.ids[more], -1)
        hit = out >= 0
        return maybe[hit], out[hit]


_CODE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64, 256, dtype=np.uint64)
_STEP = U8(0x9E3779B97F4A7C15)


def _hash(piece: bytes) -> int:
    h = np.zeros(1, U8)
    for b in piece:
        h = h * _STEP + _CODE[b]
    return int(tokens.mix(h + U8(len(piece)))[0])


def _matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes with a leading space, and their lengths."""
    n = (ends - starts + 1).astype(np.int64)
    width = int(n.max())
    rows = np.zeros((len(n), width), np.uint8)
    rows[:, 0] = 32
    inside = np.arange(1, width) < n[:, None]
    rows[:, 1:][inside] = data[(starts[:, None] + np.arange(width - 1))[inside]]
    return rows, n


def _matches(rows: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(end, length, word numbers, piece numbers) for every place that a piece fits, by rising end."""
    width = rows.shape[1]
    codes, powers = _CODE[rows], tokens.powers(int(_STEP), vocabulary.longest)
    for end in range(1, width + 1):
        live = np.flatnonzero(n >= end)
        h = np.zeros(len(live), U8)
        for length in range(1, min(end, vocabulary.longest) + 1):
            h += codes[live, end - length] * powers[length - 1]
            who, found = vocabulary.find(tokens.mix(h + U8(length)))
            if len(who):
                yield end, length, live[who], found


def forward(rows: np.ndarray, n: np.ndarray, vocabulary: Vocabulary, probability: np.ndarray) -> tuple[np.ndarray, list]:
    """Forward sums, width + 1 x words x languages (times exp(LIFT) a byte, so that none underflows), and the matches found."""
    width, languages = rows.shape[1], probability.shape[1]
    probability = probability * vocabulary.lift
    alpha = np.zeros((width + 1, len(n), languages))
    alpha[0] = 1
    matches = []
    by_end: dict[int, list] = {}
    for m in _matches(rows, n, vocabulary):
        by_end.setdefault(m[0], []).append(m)
    for end in range(1, width + 1):
        alpha[end] = alpha[end - 1] * np.exp(UNKNOWN + LIFT)
        for m in by_end.get(end, ()):
            alpha[end][m[2]] += alpha[end - m[1]][m[2]] * probability[m[3]]
            matches.append(m)
    return alpha, matches


def word_scores(rows: np.ndarray, n: np.ndarray, vocabulary: Vocabulary, probability: np.ndarray) -> np.ndarray:
    """Log probability of each short word in each language."""
    alpha, _ = forward(rows, n, vocabulary, probability)
    return np.log(alpha[n, np.arange(len(n))]) - LIFT * n[:, None]


def expected_counts(rows: np.ndarray, n: np.ndarray, vocabulary: Vocabulary, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts, vocabulary x languages, over all segmentations of short words; weight (words x languages) says
    how often each occurs. probability has one column, for all languages."""
    alpha, matches = forward(rows, n, vocabulary, probability)
    alpha, beta, probability = alpha[:, :, 0], np.zeros(alpha.shape[:2]), probability * vocabulary.lift
    beta[n, np.arange(len(n))] = 1
    share = 1 / alpha[n, np.arange(len(n))]
    counts = np.zeros((vocabulary.size, weight.shape[1]))
    at = len(matches)
    for end in range(rows.shape[1], 0, -1):
        while at and matches[at - 1][0] == end:
            at -= 1
            _, length, who, piece = matches[at]
            flow = beta[end][who] * probability[piece, 0]
            seen = (alpha[end - length][who] * flow * share[who])[:, None] * weight[who]
            for i in range(weight.shape[1]):
                counts[:, i] += np.bincount(piece, seen[:, i], vocabulary.size) if len(piece) > 1000 else 0
            if len(piece) <= 1000:
                np.add.at(counts, piece, seen)
            beta[end - length][who] += flow
        beta[end - 1] += beta[end] * np.exp(UNKNOWN + LIFT)
    return counts


def _block(data: np.ndarray, starts: np.ndarray, n: np.ndarray, at: int, upto: int, vocabulary: Vocabulary) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(end, length, word numbers, piece numbers) of all pieces that end at places at + 1 ... upto of words that begin with
    a mark before starts and have n bytes with it, by rising end."""
    before = vocabulary.longest - 1
    place = np.arange(at - before, upto)[None, :]
    byte = data[np.clip(starts[:, None] + place - 1, 0, len(data) - 1)]
    codes = _CODE[np.where(place == 0, np.uint8(32), byte)]
    ends = np.arange(at + 1, upto + 1)
    inside = ends[None, :] <= n[:, None]
    powers, h = tokens.powers(int(_STEP), vocabulary.longest), np.zeros((len(n), upto - at), U8)
    lengths, who, where, found = [], [], [], []
    for length in range(1, min(upto, vocabulary.longest) + 1):
        h += codes[:, before + 1 - length : before + 1 - length + upto - at] * powers[length - 1]
        word, end = np.nonzero(inside & (ends >= length))
        hit, piece = vocabulary.find(tokens.mix(h[word, end] + U8(length)))
        lengths.append(np.full(len(hit), length))
        who.append(word[hit])
        where.append(ends[end[hit]])
        found.append(piece)
    lengths, who, where, found = map(np.concatenate, (lengths, who, where, found))
    order = np.lexsort((who, lengths, where))
    lengths, who, where, found = lengths[order], who[order], where[order], found[order]
    cut = np.flatnonzero((np.diff(where) != 0) | (np.diff(lengths) != 0)) + 1
    return [(int(where[a]), int(lengths[a]), who[a:b], found[a:b]) for a, b in zip(np.concatenate([[0], cut]), np.append(cut, len(where)), strict=True) if b > a]


def _long_forward(data: np.ndarray, starts: np.ndarray, n: np.ndarray, vocabulary: Vocabulary, probability: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each long word in each language (n, with the mark, in descending order), and, if kept, the logs
    of all forward sums."""
    back, width, languages = vocabulary.longest, int(n[0]), probability.shape[1]
    lifted = probability * vocabulary.lift
    out, kept = np.empty((len(n), languages)), np.zeros((width + 1, len(n), languages)) if keep else None
    alpha, logs = np.zeros((back + BLOCK, len(n), languages)), np.zeros((len(n), languages))
    alpha[back - 1] = 1  # row back - 1 + k holds place at + k
    for at in range(0, width, BLOCK):
        upto = min(at + BLOCK, width)
        matches, m = _block(data, starts, n, at, upto, vocabulary), 0
        for end in range(at + 1, upto + 1):
            row = back - 1 + end - at
            live = int(np.searchsorted(-n, -end, side="right"))
            alpha[row, :live] = alpha[row - 1, :live] * np.exp(UNKNOWN + LIFT)
            while m < len(matches) and matches[m][0] == end:
                _, length, who, piece = matches[m]
                alpha[row, who] += alpha[row - length, who] * lifted[piece]
                m += 1
            if end % RESCALE == 0:
                scale = alpha[row, :live].copy()
                alpha[max(0, row - back + 1) : row + 1, :live] /= scale
                logs[:live] += np.log(scale)
            if keep:
                kept[end, :live] = np.log(alpha[row, :live]) + logs[:live]
            done = int(np.searchsorted(-n, -end, side="left"))
            if done < live:
                out[done:live] = np.log(alpha[row, done:live]) + logs[done:live] - LIFT * end
        alpha[:back] = alpha[upto - at : upto - at + back].copy()
    return out, kept


def long_counts(data: np.ndarray, starts: np.ndarray, n: np.ndarray, vocabulary: Vocabulary, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``expected_counts`` of long words (n, with the mark, in descending order)."""
    back, width = vocabulary.longest, int(n[0])
    total, alpha = _long_forward(data, starts, n, vocabulary, probability, keep=True)
    lifted, alpha, total = probability[:, 0] * vocabulary.lift[:, 0], alpha[:, :, 0], total[:, 0] + LIFT * n
    counts = np.zeros((vocabulary.size, weight.shape[1]))
    beta, logs = np.zeros((back + BLOCK + 1, len(n))), np.zeros(len(n))  # row back + k holds place at + k
    for at in range((width - 1) // BLOCK * BLOCK, -1, -BLOCK):
        upto = min(at + BLOCK, width)
        matches = _block(data, starts, n, at, upto, vocabulary)
        m = len(matches)
        for end in range(upto, at, -1):
            row = back + end - at
            live = int(np.searchsorted(-n, -end, side="right"))
            beta[row, int(np.searchsorted(-n, -end, side="left")) : live] = 1  # words that end here
            if end % RESCALE == 0:
                scale = np.maximum(beta[row, :live], 1e-300)
                beta[max(0, row - back + 1) : row + 1, :live] /= scale
                logs[:live] += np.log(scale)
            while m and matches[m - 1][0] == end:
                m -= 1
                _, length, who, piece = matches[m]
                flow = beta[row, who] * lifted[piece]
                with np.errstate(divide="ignore"):
                    seen = np.exp(alpha[end - length, who] + np.log(flow) + logs[who] - total[who])
                np.add.at(counts, piece, seen[:, None] * weight[who])
                beta[row - length, who] += flow
            beta[row - 1, :live] += beta[row, :live] * np.exp(UNKNOWN + LIFT)
        moved = np.zeros_like(beta)
        if at:  # the places at - back ... at move to where the block before has them
            moved[BLOCK : BLOCK + back + 1] = beta[: back + 1]
        beta = moved
    return counts


def _groups(n: np.ndarray, languages: int) -> Iterator[np.ndarray]:
    """Long words by falling length, in groups of bounded work space (one word at least)."""
    order, a = np.argsort(-n, kind="stable"), 0
    while a < len(order):
        rows = min(int(n[order[a]]), BLOCK)
        size = max(1, 2_000_000 // (rows * max(8, languages)))
        yield order[a : a + size]
        a += size


def scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary, probability: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out, n = np.empty((len(starts), probability.shape[1])), ends - starts
    short = np.flatnonzero(n <= SHORT)
    step = max(500, 80_000 // probability.shape[1])
    for a in range(0, len(short), step):
        some = short[a : a + step]
        for mine, rows, size in by_width(data, starts[some], ends[some]):
            out[some[mine]] = word_scores(rows, size, vocabulary, probability)
    long = np.flatnonzero(n > SHORT)
    for mine in _groups(n[long], probability.shape[1]):
        out[long[mine]] = _long_forward(data, starts[long[mine]], n[long[mine]] + 1, vocabulary, probability)[0]
    return out


def counts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of words of any length."""
    out, n = np.zeros((vocabulary.size, weight.shape[1])), ends - starts
    short = np.flatnonzero(n <= SHORT)
    for a in range(0, len(short), 20_000):
        some = short[a : a + 20_000]
        for mine, rows, size in by_width(data, starts[some], ends[some]):
            out += expected_counts(rows, size, vocabulary, probability, weight[some[mine]])
    long = np.flatnonzero(n > SHORT)
    for mine in _groups(n[long], 8):
        out += long_counts(data, starts[long[mine]], n[long[mine]] + 1, vocabulary, probability, weight[long[mine]])
    return out


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct word, and for every word its number."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return first, inverse


class _Tally:
    """Distinct words with their counts by language; turned into expected piece counts when many have come together."""

    def __init__(self, vocabulary: Vocabulary, languages: int, most: int = 400_000) -> None:
        self.vocabulary, self.most = vocabulary, most
        self.counts = np.zeros((vocabulary.size, languages))
        self.flat = np.full((vocabulary.size, 1), 1.0 / vocabulary.size)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # bytes, lengths, hashes, counts by language
        self.words = 0

    def add(self, w: tokens.Words, which: np.ndarray) -> None:
        first, number = _distinct(w.hashes)
        owner, languages = np.repeat(which, w.counts), self.counts.shape[1]
        weight = np.bincount(number[owner >= 0] * languages + owner[owner >= 0], minlength=len(first) * languages).reshape(len(first), -1)
        n = w.ends[first] - w.starts[first]
        at = np.arange(n.sum()) + np.repeat(w.starts[first] - (np.cumsum(n) - n), n)
        self.held.append((w.data[at], n, w.hashes[first], weight))
        self.words += len(first)
        if self.words > self.most:
            self.merge()
            if self.words > self.most // 2:
                self.flush()

    def merge(self) -> None:
        data, n, hashes, weight = (np.concatenate(x) for x in zip(*self.held, strict=True))
        first, number = _distinct(hashes)
        starts = np.cumsum(n) - n
        at = np.arange(n[first].sum()) + np.repeat(starts[first] - (np.cumsum(n[first]) - n[first]), n[first])
        summed = np.stack([np.bincount(number, weight[:, i], len(first)) for i in range(weight.shape[1])], axis=1)
        self.held, self.words = [(data[at], n[first], hashes[first], summed)], len(first)

    def flush(self) -> None:
        if self.held:
            self.merge()
            data, n, _, weight = self.held[0]
            ends = np.cumsum(n)
            self.counts += counts_of(data, ends - n, ends, self.vocabulary, self.flat, weight)
        self.held, self.words = [], 0


def learn(documents: DataFrame, text: str, lang: str, languages: list[str], path: str | None = None) -> np.ndarray:
    """Piece probabilities, vocabulary x languages."""
    places = {name: i for i, name in enumerate(languages)}
    size = len(pieces(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(Vocabulary(pieces(path)), len(languages))
        for batch in batches:
            which = np.array([places.get(x, -1) for x in batch[lang].to_pylist()], np.int64)
            for lo, hi, w in tokens.chunks(batch[text]):
                if len(w.hashes):
                    tally.add(w, which[lo:hi])
        tally.flush()
        for i in range(len(languages)):
            yield pa.RecordBatch.from_pydict({"language": pa.array([i], pa.int32()), "counts": pa.array([tally.counts[:, i].tobytes()])})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py()) for c in table["counts"])
        return pa.table({"language": table["language"][:1], "counts": pa.array([total.tobytes()])})

    rows = documents.select(text, lang).mapInArrow(count, "language int, counts binary").groupBy("language").applyInArrow(add, "language int, counts binary").collect()
    found = np.zeros((size, len(languages)))
    for r in rows:
        found[:, r["language"]] = np.frombuffer(r["counts"])
    return (found + SMOOTH) / (found + SMOOTH).sum(axis=0)


def by_width(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Short words in groups of like length, so that shorter ones don't pay for longer ones."""
    n = ends - starts
    order = np.argsort(n, kind="stable")
    limits = np.searchsorted(n[order], [5, 8, 11, 15, 22, SHORT + 1])
    for a, b in zip([0, *limits[:-1]], limits, strict=True):
        if b > a:
            mine = order[a:b]
            rows, size = _matrix(data, starts[mine], ends[mine])
            yield mine, rows, size


def identify(documents: DataFrame, key: str, text: str, languages: list[str], probability: np.ndarray, path: str | None = None) -> DataFrame:
    """key, lang_pred, score (the posterior of the predicted language)."""
    kind = documents.schema[key].dataType.simpleString()
    model = probability.astype(np.float32)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = Vocabulary(pieces(path)), model.astype(np.float64)
        bits = max(10, _CACHE_BITS - max(0, len(languages) - 1).bit_length())
        known = np.zeros(1 << bits, U8)  # scores of words met before, by slot
        scored = np.zeros((1 << bits, max(1, len(languages))))
        limit = max(1 << 16, 4 * tokens.CHUNK_BYTES // max(4, len(languages)))
        for batch in batches:
            letters = pc.match_substring_regex(batch[text], r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            total = np.zeros((batch.num_rows, len(languages)))
            for lo, hi, w in tokens.chunks(batch[text], limit):
                if not len(w.hashes) or not languages:
                    continue
                names, first, number = np.unique(w.hashes, return_index=True, return_inverse=True)
                slot = (names & U8((1 << bits) - 1)).astype(np.int64)
                score = scored[slot]
                new = np.flatnonzero(known[slot] != names)
                score[new] = scores(w.data, w.starts[first[new]], w.ends[first[new]], vocabulary, table)
                known[slot[new]], scored[slot[new]] = names[new], score[new]
                owner = np.repeat(np.arange(hi - lo), w.counts)
                for i in range(len(languages)):
                    total[lo:hi, i] = np.bincount(owner, score[number, i], hi - lo)
            if languages:
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                answer = [languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                share = np.where(letters, share, 0.0)
            else:
                answer, share = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(answer, pa.string()), pa.array(share)], names=[key, "lang_pred", "score"])

    return documents.select(key, text).mapInArrow(predict, f"`{key}` {kind}, lang_pred string, score double")


def language_id(documents: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> DataFrame:
    """The operator: learns from ``training`` (rows with a language), then answers for every document."""
    labelled = training.where(F.col(lang).isNotNull())
    languages = sorted(r[0] for r in labelled.select(lang).distinct().collect())
    probability = learn(labelled, text, lang, languages, path) if languages else np.zeros((1, 0))
    return identify(documents, key, text, languages, probability, path)
