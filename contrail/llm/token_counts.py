"""Token counts of whole texts: pieces are counted once for each distinct pre-token and summed over each document's pre-token frequencies.

A byte-level BPE merges inside pre-tokens only, so a text's count is the sum over its distinct pre-tokens of frequency times pieces; ids never
exist. Documents of about `BLOCK` bytes of text are a block with one dictionary of pre-tokens, so a common pre-token crosses a
shuffle once a block and not once a document. The block's dictionary joins the counts; the counts come back to the block, where each document
sums them over its own frequencies.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import column, slices, stage

#: Bytes of text of one block; a longer text is a block of its own.
BLOCK = 1 << 24
#: Counted words of one task that go back to their blocks together.
ROWS = 1 << 20
#: White space as the library's pattern knows it: Unicode's 25 code points.
WHITE = r"\t-\r \x85\xa0  -     　"
#: Code points whose class is the same here and in the library (a test tries them all). Of others, later versions of Unicode assign more as
#: letters: the library itself splits texts that hold one.
PLAIN = ((0x0000, 0x052F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


def _ranges(kind: str) -> str:
    """The plain code points of a general category as the inside of a pattern's class."""
    own = [c for low, high in PLAIN for c in range(low, high + 1) if category(chr(c))[0] == kind]
    ends = [i for i, c in enumerate(own) if i + 1 == len(own) or own[i + 1] != c + 1]
    return "".join(f"\\u{own[a]:04x}-\\u{own[b]:04x}" for a, b in zip([0, *(i + 1 for i in ends)], ends))


OTHER = re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in PLAIN) + "]")
_LETTER, _NUMBER = _ranges("L"), _ranges("N")
#: The byte-level pattern on plain code points.
PRE_TOKEN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?(?:[{_LETTER}]+|[{_NUMBER}]+|[^{WHITE}{_LETTER}{_NUMBER}]+)|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: A pre-token never reaches from a character that isn't white to white space behind it, and no lookahead does: there texts may be cut for the library.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of a byte-level BPE file, once a worker; other kinds are a ValueError, as they don't merge inside pre-tokens of this kind."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        own = Tokenizer.from_file(path)
        plain = isinstance(own.pre_tokenizer, pre_tokenizers.ByteLevel) and own.pre_tokenizer.use_regex and not own.pre_tokenizer.add_prefix_space
        if not plain or own.normalizer is not None:
            raise ValueError(f"{path}: not a byte-level BPE without normalizer and prefix space")
        if any(t.single_word or t.lstrip or t.rstrip for t in own.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: added tokens that look at what stands beside them")
        own.no_truncation()
        own.no_padding()
        _loaded[path] = own
    return _loaded[path]


def pre_token_counts(path: str):
    """A function from a text to its pre-tokens with their frequencies; added tokens inside it are one pre-token each, as they are."""
    own = tokenizer(path)
    added = sorted((t.content for t in own.get_added_tokens_decoder().values()), key=len, reverse=True)
    names, special = set(added), re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    @lru_cache(1 << 16)
    def split(chunk: str) -> tuple[str, ...]:
        return tuple(chunk[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(chunk))

    def by_library(text: str) -> Counter[str]:
        out: Counter[str] = Counter()
        for chunk, n in Counter(CHUNK.findall(text)).items():
            for word in (split if len(chunk) <= 64 else split.__wrapped__)(chunk):  # long chunks aren't kept
                out[word] += n
        return out

    def plain(text: str) -> Counter[str]:
        return by_library(text) if OTHER.search(text) else Counter(PRE_TOKEN.findall(text))

    def run(text: str) -> Counter[str]:
        if special is None or not special.search(text):
            return plain(text)
        out: Counter[str] = Counter()
        for part in special.split(text):
            out.update({part: 1} if part in names else plain(part))
        return out

    return run


BLOCKS = "block long, words array<string>, doc_ids array<long>, n_bytes array<long>, sizes array<int>, packed binary"


def pack(numbers: np.ndarray) -> bytes:
    """Small whole numbers as zstd of their bytes, lowest bytes first."""
    return pa.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, count: int) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=4 * count, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, count).T).view("<i4").reshape(count).astype(np.int64)


def _blocks(path: str):
    """One row for each block: its distinct pre-tokens, and packed for each document the pre-tokens it holds (as places in words, ascending, each as the
    step from the one before) and their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, block = pre_token_counts(path), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BLOCK):
            texts = column(batch, "text")
            place: dict[str, int] = {}
            sizes, steps, freqs = [], [], []
            for text in texts:
                mine = count(text.as_py() or "")
                for word in mine:
                    if word not in place:
                        place[word] = len(place)
                at = np.fromiter(map(place.__getitem__, mine), np.int64, len(mine))
                order = np.argsort(at)
                steps.append(np.diff(at[order], prepend=0))
                freqs.append(np.fromiter(mine.values(), np.int64, len(mine))[order])
                sizes.append(len(mine))
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block], pa.int64()), "words": pa.array([list(place)], pa.list_(pa.string())), "doc_ids": pa.array([column(batch, "doc_id").to_pylist()], pa.list_(pa.int64())),
                    "n_bytes": pa.array([n_bytes.to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int32())), "packed": pa.array([pack(np.concatenate(steps + freqs))], pa.binary()),
                }
            )
            block += 1

    return run


def _returned(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Places and pieces of words, one row for each block: packed as the places' steps and the pieces."""
    block, at, pieces = (np.concatenate([r[i] for r in rows]) if rows else np.empty(0, np.int64) for i in range(3))
    order = np.lexsort((at, block))
    block, at, pieces = block[order], at[order], pieces[order]
    cuts = np.flatnonzero(np.diff(block, prepend=block[:1] - 1))
    parts = list(zip(np.split(at, cuts[1:]), np.split(pieces, cuts[1:]))) if len(block) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(block[cuts]), pa.array([len(x) for x, _ in parts], pa.int32()), pa.array([pack(np.concatenate([np.diff(x, prepend=0), y])) for x, y in parts], pa.binary())], ["block", "n", "pieces"]
    )


def _pieces(path: str):
    """Rows sorted by word: the library counts the pieces of each distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, pieces, held = tokenizer(path), None, 0, []
        for batch in slices(batches, "word"):
            words = column(batch, "word").dictionary_encode()
            distinct = words.dictionary.to_pylist()
            n = [pieces if w == last else 0 for w in distinct]
            new = [i for i, w in enumerate(distinct) if w != last]
            for i, e in zip(new, own.encode_batch_fast([distinct[i] for i in new], add_special_tokens=False)):
                n[i] = len(e.ids)
            last, pieces = distinct[-1], n[-1]
            held.append((column(batch, "block").to_numpy(), column(batch, "at").to_numpy().astype(np.int64), np.array(n)[words.indices.to_numpy()]))
            if sum(len(h[0]) for h in held) >= ROWS:
                yield _returned(held)
                held = []
        yield _returned(held)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the pieces of their words (counts: one for each place) to documents with their tokens."""
    for batch in batches:
        for row in range(batch.num_rows):
            values = lambda name: column(batch, name)[row].values  # noqa: B023, E731
            counts = column(batch, "counts")[row].as_py()
            by_place = np.zeros(sum(c["n"] for c in counts), np.int64)
            for c in counts:
                steps, pieces = np.split(unpack(c["pieces"], 2 * c["n"]), 2)
                by_place[np.cumsum(steps)] = pieces
            sizes = values("sizes").to_numpy()
            ends, total = np.cumsum(sizes, dtype=np.int64), int(sizes.sum())
            steps, freq = np.split(unpack(column(batch, "packed")[row].as_py(), 2 * total), 2)
            walked = np.concatenate([[0], np.cumsum(steps)])
            at = walked[1:] - np.repeat(walked[ends - sizes], sizes)
            tokens = np.concatenate([[0], np.cumsum(by_place[at] * freq)])
            n = tokens[ends] - tokens[ends - sizes]
            yield pa.RecordBatch.from_arrays([values("doc_ids"), values("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text): bytes (UTF-8) and tokens of the whole text, as the library
    counts them for the byte-level BPE file at path (the same path on every executor), added tokens inside texts recognised, none put
    around them, nothing cut or filled up; over_limit: more than `limit` tokens.

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows each count; texts of any length are
    read whole, the longest as blocks of their own; an empty table gives no rows; other columns are ignored, whatever their names.
    Writes blocks to the shared folder when it is called.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = stage(docs.mapInArrow(_blocks(path), BLOCKS))
    # a word has one row in a block at most, so the most common one has a small share of the rows
    rows = blocks.select("block", F.posexplode("words").alias("at", "word")).repartition("word").sortWithinPartitions("word")
    found = rows.mapInArrow(_pieces(path), "block long, n int, pieces binary").groupBy("block").agg(F.collect_list(F.struct("n", "pieces")).alias("counts"))
    whole = blocks.drop("words").join(found, "block", "left").withColumn("counts", F.coalesce("counts", F.array().cast("array<struct<n:int,pieces:binary>>")))
    out = whole.mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 512)
