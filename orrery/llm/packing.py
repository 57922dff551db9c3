"""Best-fit packing of tokenized documents into sequences of bounded length.

A document is its token ids and an end id. Only documents longer than ``SEQUENCE`` are cut: the first piece takes the
remainder and may be shorter, all others fill a sequence. Pieces are dealt evenly to packing groups by hash; each group
is packed longest piece first by vector best fit: a bin has three residual capacities (tokens, pieces, attention cost,
which is the sum of squared piece lengths), a piece goes only to bins where it fits under all three, and among those to
the one whose residuals after it have the least weighted norm.

Null text is empty (one end id). Null and repeated ids, and repeated rows, give separate pieces; the group and the order
depend on content only, so reruns agree. An empty table has no pieces. Other columns are ignored, whatever their names. A
text is tokenized whole; its pieces are made one at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE, END_ID, GROUP_PIECES, PIECES_PER_SEQUENCE = 1024, 2, 16_384, 1024
#: Weights of the residual tokens, pieces and attention cost, each as a share of its capacity. By default pieces and cost
#: only tell bins apart: a sequence of 1024 tokens has no room for more than 1024 pieces, and a cost that still admits a
#: piece of 1023 tokens is spent by no other. Lower capacities bind, and need more sequences.
WEIGHTS = (1.0, 0.3, 0.3)


def tokenizer(ranks_path: str | None = None, special: bool = True) -> Callable[[str], np.ndarray]:
    """Token ids of a text. The vocabulary of byte_bpe_50k.json is read in its form of ranks, which gives the same ids
    several times as fast. With ``special``, strings of the JSON's added tokens get their ids, as tokenizers gives them;
    without, they are ordinary text."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    added: dict[str, int] = {}
    if special:
        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as whole:
            added = {t["content"]: t["id"] for t in json.load(whole)["added_tokens"]}
    encoder = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    core, allowed = encoder._core_bpe, set(added)
    if hasattr(core, "encode_to_tiktoken_buffer"):
        return lambda text: np.frombuffer(core.encode_to_tiktoken_buffer(text, allowed), np.uint32)
    return lambda text: np.array(encoder.encode(text, allowed_special=allowed, disallowed_special=()), np.uint32)


def pieces(documents: DataFrame, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, ranks_path: str | None = None, with_ids: bool = False, special: bool = True) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, if asked for, ids: one row a piece."""
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(ranks_path, special)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            ids: list[np.ndarray] = []
            for i, t in enumerate(batch[text]):
                found = np.append(encode(t.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                raw, n = memoryview(found.tobytes()), len(found)
                at = 0
                for p in range(-(-n // sequence)):
                    upto = n - (-(-n // sequence) - 1 - p) * sequence
                    rows.append((i, p, at, upto - at, zlib.crc32(raw[4 * at : 4 * upto])))
                    if with_ids:
                        ids.append(found[at:upto].astype(np.int32))
                    at = upto
            cols = np.array(rows, np.int64).reshape(-1, 5)
            out = [batch[key].take(pa.array(cols[:, 0])), pa.array(cols[:, 1].astype(np.int32)), *(pa.array(cols[:, k]) for k in (2, 3, 4))]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[:, 3])]).astype(np.int32)), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]))))
            yield pa.RecordBatch.from_arrays(out, names=[key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return documents.select(key, text).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, sequence: int = SEQUENCE, most_pieces: int = PIECES_PER_SEQUENCE, most_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin and its place there. Lengths must be in descending order.

    Every bin that still has tokens left is a candidate for every piece. Of those with room under all three capacities the
    one is taken whose residual vector after the piece, each part as a share of its capacity, has the least weighted square
    norm; of equal ones the bin that was opened first. A piece that fits nowhere opens a bin.
    """
    capacity = np.array([sequence, most_pieces, most_cost or sequence * sequence], float)
    scale = np.array(weights) / capacity**2
    room = np.empty((3, 256))  # residuals of the open bins
    name = np.empty(256, np.int64)
    where, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_, made = 0, 0
    for i, n in enumerate(lengths.tolist()):
        need = np.array([[n], [1], [n * n]], float)
        left = room[:, :open_] - need
        norm = scale @ (left * left)
        norm[left.min(axis=0) < 0] = np.inf
        best = int(norm.argmin()) if open_ else -1
        if best < 0 or norm[best] == np.inf:
            if open_ == len(name):
                room, name = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([name, np.empty_like(name)])
            best, open_, made = open_, open_ + 1, made + 1
            room[:, best], name[best] = capacity, made - 1
        where[i], at[i] = name[best], sequence - room[0, best]
        room[:, best] -= need[:, 0]
        if room[0, best] <= 0 or room[1, best] <= 0 or room[2, best] <= 0:  # nothing fits any more: it leaves the candidates
            room[:, best : open_ - 1], name[best : open_ - 1] = room[:, best + 1 : open_], name[best + 1 : open_]
            open_ -= 1
    return where, at


def pack(cut: DataFrame, key: str = "doc_id", sequence: int = SEQUENCE, most_pieces: int = PIECES_PER_SEQUENCE, most_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset. Whole sequences stay where they are; the other pieces are packed in groups."""
    n = cut.where(F.col("length") < sequence).count()
    groups = max(1, math.ceil(n / group_pieces))
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cut.columns) + ", sequence_id long, offset long"

    def packed(table: pa.Table) -> pa.Table:
        group = table["_group"][0].as_py()
        table = table.drop_columns(["_group"]).sort_by([("length", "descending"), (key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, at = best_fit(table["length"].to_numpy(), sequence, most_pieces, most_cost, weights)
        return table.append_column("sequence_id", pa.array(bins * groups + group)).append_column("offset", pa.array(at))

    short = cut.where(F.col("length") < sequence).withColumn("_group", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    short = short.groupBy("_group").applyInArrow(packed, schema)
    # a full piece is a sequence; negative numbers, told apart by partition and row, don't meet those of the groups
    full = cut.where(F.col("length") >= sequence).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(short)


def best_fit_packing(documents: DataFrame, key: str = "doc_id", text: str = "text", with_ids: bool = False, special: bool = True, **how) -> DataFrame:
    """The operator: pieces with sequence_id and offset. ``special`` as in ``tokenizer``."""
    from orrery.llm.parts import cut_lineage

    made = cut_lineage(pieces(documents, key, text, sequence=how.get("sequence", SEQUENCE), with_ids=with_ids, ranks_path=how.pop("ranks_path", None), special=special))
    return pack(made, key, **how)
