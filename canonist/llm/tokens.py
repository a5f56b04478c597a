"""Token counts without token ids.

Texts are cut, in blocks, into pre-tokens as the tokenizer's own library cuts them. A block holds its different pre-tokens once, in the
order of a hash, and for every document the places and frequencies of its own. Blocks are joined with the pieces of their
pre-tokens by ranges of that hash: all blocks' pre-tokens of one range meet in one task, where each different one is counted once, and
the counts go back to the blocks. A document's tokens are the sum of its frequencies times these counts. A block tells each pre-token once, so
no frequent pre-token is hot, and no row is made for a document and a pre-token.

Defined cases: a null text is empty; an empty text has no bytes and no tokens; null doc_ids are kept; repeated rows are counted each
on its own; an empty table gives no rows; very long texts are whole and may fill a block. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merge

BLOCK = 8_000_000  # characters of a block; a longer text is a block of its own
RANGE = 200_000  # pre-tokens of all blocks that meet in one range of the hash, on average
LIMIT = 512
#: Characters that every library takes for white space, and those that some of them do.
SPACE, PERHAPS = r" \t\n\r\x0b\x0c", r"\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
BLOCKS = "block long, n_words long, words binary, doc_ids array<long>, bytes array<long>, upto array<long>, places binary, times binary"
RANGES = "block long, nth long, words binary"
COUNTED = "doc_id long, n_bytes long, n_tokens long"


def chunks(space: str, perhaps: str) -> re.Pattern:
    """Stretches that end where certain white space follows what is none for certain: no pre-token crosses that."""
    s, p = f"[{space}{perhaps}]", f"[{perhaps}]"
    other = s.replace("[", "[^", 1)
    return re.compile(f"{s}*{other}*(?:{p}{s}*{other}*)*")


class BytePairs:
    """Pre-tokens and their pieces by the tokenizers library. A chunk that holds a special string is a word of its own, since the
    library looks for these first."""

    PLAIN = ("ByteLevel", "Split", "Sequence")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        told = json.loads(self.tokenizer.to_str())
        parts = [told["pre_tokenizer"], *told["pre_tokenizer"].get("pretokenizers", [])]
        if any(t["rstrip"] or t["single_word"] or t["normalized"] for t in told["added_tokens"]) or any(p["type"] not in self.PLAIN or p.get("add_prefix_space") for p in parts):
            raise ValueError(f"{path}: its pre-tokens or special strings reach over white space")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in told["added_tokens"]) or "(?!)")
        self.pattern = chunks(SPACE, PERHAPS)

    def front(self, text: str) -> str:
        return text

    def words(self, chunk: str) -> list[str]:
        if self.special.search(chunk):
            return ["s" + chunk]
        normal = self.tokenizer.normalizer.normalize_str(chunk) if self.tokenizer.normalizer else chunk
        return ["w" + word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, word: str) -> int:
        return len(self.tokenizer.encode(word[1:], add_special_tokens=False).ids if word[0] == "s" else self.tokenizer.model.tokenize(word[1:]))


class SentencePieces:
    """The same by sentencepiece, for models that put one space in front of a text and change no white space: a chunk is a word."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        kept = self.model.decode(self.model.encode("a  b ")) == "a  b "
        if any("\u2581" in piece.lstrip("\u2581") for piece in pieces) or not kept or self.model.piece_to_id("\u2581") == self.model.unk_id():
            raise ValueError(f"{path}: its pieces reach over white space")
        self.pattern = chunks(" ", "\u2581")

    def front(self, text: str) -> str:
        return " " + text if text else text

    def words(self, chunk: str) -> list[str]:
        return [chunk]

    def pieces(self, word: str) -> int:
        return len(self.model.encode(word[1:])) or 1  # the model puts the space in front again, but not before nothing


@functools.cache
def library(path: str) -> BytePairs | SentencePieces:
    """Read once in each Python worker."""
    return BytePairs(path) if path.endswith(".json") else SentencePieces(path)


class Block:
    """Documents with their frequencies of the words that the block holds once."""

    def __init__(self, lib: BytePairs | SentencePieces):
        self.lib, self.size, self.known, self.of = lib, 0, {}, {}
        self.doc_ids, self.bytes, self.upto, self.places, self.times = [], [], [0], array("I"), array("I")

    def add(self, doc_id: int | None, text: str) -> None:
        own: Counter[int] = Counter()
        for chunk, n in Counter(self.lib.pattern.findall(self.lib.front(text))).items():
            if (held := self.of.get(chunk)) is None:
                held = self.of[chunk] = [self.known.setdefault(w, len(self.known)) for w in self.lib.words(chunk)] if chunk else []
            for place in held:
                own[place] += n
        self.size += len(text)
        self.doc_ids.append(doc_id), self.bytes.append(len(text.encode("utf-8", "surrogatepass")))
        self.places.extend(own.keys())
        self.times.extend(own.values())
        self.upto.append(len(self.places))

    def row(self) -> pa.RecordBatch:
        words = list(self.known)
        order = np.argsort(hashes(words), kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        own = np.repeat(np.arange(len(self.doc_ids)), np.diff(self.upto))
        places, times = place[np.asarray(self.places, np.int64)], np.asarray(self.times, np.int64)
        sort = np.lexsort((places, own))  # a document's places rise, and only their differences are kept
        starts = np.asarray(self.upto[:-1], np.int64)[np.diff(self.upto) > 0]
        gaps = np.diff(places[sort], prepend=0)
        gaps[starts] = places[sort][starts]
        values = [[0], [len(words)], [packed_words([words[i] for i in order])], [self.doc_ids], [self.bytes], [self.upto], [packed(gaps)], [packed(times[sort])]]
        many = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int64(), pa.binary(), many, many, many, pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, their bytes of equal weight together, compressed."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def packed_words(words: list[str]) -> bytes:
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = packed(np.fromiter(map(len, data), np.int64, len(data)))
    return len(sizes).to_bytes(4, "little") + sizes + zlib.compress(b"".join(data), 1)


def unpacked_words(data: bytes) -> list[str]:
    at = 4 + int.from_bytes(data[:4], "little")
    sizes, text = unpacked(data[4:at]), zlib.decompress(data[at:])
    ends = np.cumsum(sizes).tolist()
    return [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1]], ends)]


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))


def blocks(documents: DataFrame, tokenizer: str, size: int = BLOCK) -> DataFrame:
    """A row a block: its different words, and for each document bytes, places of its words, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer)
        block = Block(lib)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                if block.doc_ids and block.size + len(text) > size:
                    yield block.row()
                    block = Block(lib)
                block.add(doc_id.as_py(), text)
        if block.doc_ids:
            yield block.row()

    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, BLOCKS).withColumn("block", F.monotonically_increasing_id())


def ranges(held: DataFrame, n: int) -> DataFrame:
    """block, nth, words: each block's words in n ranges of their hash, empty ones left out."""
    bounds = [(k << 32) // n for k in range(1, n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = unpacked_words(data.as_py())
                cuts = [0, *np.searchsorted(hashes(words), bounds).tolist(), len(words)]
                own = [k for k in range(n) if cuts[k] < cuts[k + 1]]
                lists = [pa.array(x, t) for x, t in (([block] * len(own), pa.int64()), (own, pa.int64()), ([packed_words(words[cuts[k] : cuts[k + 1]]) for k in own], pa.binary()))]
                yield pa.record_batch(lists, names=["block", "nth", "words"])

    return held.select("block", "words").mapInArrow(run, RANGES)


def piece_counts(rows: DataFrame, tokenizer: str) -> DataFrame:
    """block, nth, pieces (packed, in the order of words): rows of one range meet, and each different word is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, now, known = library(tokenizer), None, {}
        for batch in batches:
            out = []
            for nth, words in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if nth != now:
                    now, known = nth, {}
                for w in (words := unpacked_words(words.as_py())):
                    if w not in known:
                        known[w] = lib.pieces(w)
                out.append(packed(np.fromiter((known[w] for w in words), np.int64, len(words))))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "nth", "pieces"])

    return rows.repartition("nth").sortWithinPartitions("nth").mapInArrow(run, "block long, nth long, pieces binary")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            gaps, times, upto = unpacked(row["places"]), unpacked(row["times"]), np.asarray(row["upto"])
            pieces = np.concatenate([np.zeros(0, np.int64), *map(unpacked, row["pieces"] or [])])
            risen = np.concatenate([[0], np.cumsum(gaps)])
            places = risen[1:] - np.repeat(risen[upto[:-1]], np.diff(upto))
            sums = np.concatenate([[0], np.cumsum(pieces[places] * times)])
            yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(row["bytes"], pa.int64()), pa.array(np.diff(sums[upto]), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = LIMIT, size: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document; tokenizer is the path of a .json or .model file."""
    held = Scratch(documents.sparkSession).stored(blocks(documents, tokenizer, size), "blocks")
    words = held.agg(F.sum("n_words")).first()[0] or 0
    counted = piece_counts(ranges(held, -(-words // RANGE) or 1), tokenizer)
    back = counted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("nth", "pieces"))).alias("told"))
    summed = held.drop("words", "n_words").join(merge(back), "block", "left").select(*[c for c in held.columns if c not in ("block", "words", "n_words")], F.col("told.pieces").alias("pieces"))
    return summed.mapInArrow(_sums, COUNTED).withColumn("over_limit", F.col("n_tokens") > limit)
