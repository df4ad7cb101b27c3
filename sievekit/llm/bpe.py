"""BPE encoding and decoding with a contiguous rank array.

A word is held as a list of token ids (the parts between boundaries) and a list of the merge ranks of
neighbouring parts. The smallest rank is looked for again and again, its boundary is deleted and the
two ranks beside it are looked up anew. Words over LONG bytes keep the same order of merges in a heap,
so that a run of a million letters costs n log n.

Null texts encode as empty ones: no ids. Empty texts give no ids. Repeated rows are encoded each.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG = 400
CACHE_WORDS = 200_000
NO_RANK = 1 << 60
#: The pattern that byte-level BPE files of this kind split text by before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: visible Latin-1 letters for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def latin_pattern() -> str:
    """PATTERN for texts within Latin-1, with its classes written out: the plain re module takes these, at twice the speed."""
    import regex

    def members(kind: str) -> str:
        return "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(kind, c))

    letters, digits, spaces = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]").replace(r"(?!\S)", f"(?![^{spaces}])").replace(r"\s+", f"[{spaces}]+")


class _Words(dict):
    """word -> its ids and their decimal text, filled on demand."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, word: str):
        if (found := self.older.get(word)) is None:
            ids = self.codec.merged(word.encode("utf-8"))
            found = (tuple(ids), ",".join(map(str, ids)))
        self[word] = found
        return found

    def aged(self) -> None:
        """Bounds the memory: words not met since the last call go."""
        self.older = dict(self)
        self.clear()


#: What a vocabulary file has to say of itself, as PATTERN and the merges are all that is done to a text.
SUPPORTED = {
    "normalizer": (None,), "pre_tokenizer.type": ("ByteLevel",), "pre_tokenizer.add_prefix_space": (False,), "pre_tokenizer.use_regex": (None, True), "post_processor": (None,), "decoder.type": ("ByteLevel",),
    "model.type": ("BPE",), "model.dropout": (None, 0), "model.unk_token": (None,), "model.continuing_subword_prefix": (None, ""), "model.end_of_word_suffix": (None, ""), "model.byte_fallback": (None, False), "model.ignore_merges": (None, False),
}


def unsupported(file: dict) -> list[str]:
    """The settings of a vocabulary file that would give other ids than this codec does."""
    out = []
    for name, good in SUPPORTED.items():
        part, _, field = name.partition(".")
        value = file.get(part)
        value = (value or {}).get(field) if field else value
        if value not in good:
            out.append(f"{name} = {value!r}")
    for token in file["added_tokens"]:
        out += [f"{flag} of {token['content']}" for flag in ("single_word", "lstrip", "rstrip", "normalized") if token.get(flag)]
    return out


class Codec:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        unlike = unsupported(file)
        if unlike:
            raise ValueError(f"{path} asks for what this codec does not do: {', '.join(unlike)}")
        vocab = file["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.pairs: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            key = vocab[left] << 20 | vocab[right]
            self.pairs[key] = rank
            self.made[rank] = vocab[left + right]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode("utf-8") for t, i in self.special.items()}
        self.split_any = regex.compile(PATTERN).findall
        self.split_latin = re.compile(latin_pattern()).findall
        self.first_ranks = [[self.pairs.get(a << 20 | b, NO_RANK) for b in self.first] for a in self.first]
        longest_first = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(longest_first) + ")") if longest_first else None
        self.words = _Words(self)

    def merged(self, word: bytes) -> list[int]:
        ids = [self.first[b] for b in word]
        if len(ids) < 2:
            return ids
        if len(ids) > LONG:
            return self._merged_long(ids)
        rank_of, made = self.pairs.get, self.made
        first = self.first_ranks
        ranks = [first[a][b] for a, b in zip(word, word[1:])]
        while ranks and (least := min(ranks)) != NO_RANK:
            k = ranks.index(least)
            ids[k] = joined = made[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank_of(ids[k - 1] << 20 | joined, NO_RANK)
            if k < len(ranks):
                ranks[k] = rank_of(joined << 20 | ids[k + 1], NO_RANK)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.pairs.get(a << 20 | b)) is not None]
        heapq.heapify(heap)

        def offer(k: int, j: int) -> None:
            if (r := self.pairs.get(ids[k] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (r, k, ids[k], ids[j]))

        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:  # one of the two parts is gone
                continue
            ids[k], ids[j] = self.made[rank], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                offer(k, after[k])
            if before[k] >= 0:
                offer(before[k], k)
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def pieces(self, text: str) -> Iterator[tuple[tuple[int, ...], str]]:
        """(ids, their decimal text) of each word and special token of the text."""
        if self.specials is None or not any(s in text for s in self.special):
            return map(self.words.__getitem__, self.split(text))
        return chain.from_iterable([((i := self.special[part],), str(i))] if part in self.special else map(self.words.__getitem__, self.split(part)) for part in self.specials.split(text))

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and the ids in decimal joined by commas."""
        if len(self.words) > CACHE_WORDS:
            self.words.aged()
        found = list(self.pieces(text))
        return list(chain.from_iterable([ids for ids, _ in found])), ",".join([s for _, s in found])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_table(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """The columns in keep, then n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again) and, if asked for, ids. The vocabulary file has to be where every executor can open it."""
    kept = [F.col(f"`{c}`") for c in keep]
    source = docs.select(*kept, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    fields = [*source.drop("__text").schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def encoded(batches):
        import pyarrow as pa

        gc.disable()  # the cache holds many small tuples and no cycles
        codec = Codec(vocabulary)
        for batch in batches:
            counts, hashes, decoded, all_ids = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                ids, digits = codec.encode(text.as_py())
                counts.append(len(ids))
                hashes.append(hashlib.sha256(digits.encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append(pa.array(ids, pa.int32()))
            out = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                offsets = pa.array([0, *accumulate(counts)], pa.int32())
                out.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return source.mapInArrow(encoded, T.StructType(fields))
