"""BPE encoding and decoding over tables of distinct words.

Texts are split into words, the words of a slice of a batch (SLICE bytes of text) are made a dictionary, each distinct
word is joined with the worker's table of words and their ids, those that are new are encoded and added to it, and the ids
come back to the words' places by a join of positions with that table. Decoding joins ids with the table of pieces in
the same way. The table is columns of Arrow; over TABLE_ROWS words it starts anew with those of the slice. One table
for the whole corpus would need the words of every slice shuffled out and their ids shuffled back; a table by worker
moves nothing.

Words are what stands between single spaces, with the space in front: no token of these vocabularies reaches over
the next space, unless spaces meet (then the whole text goes through the full pattern). Pieces are encoded by byte
ranks; pieces of more than LONG_PIECE bytes, where ranks take the square of the length, by the library's model.

Null counts as empty, which has no ids; repeated rows give repeated results; order and ties don't matter, as each
row is handled alone; an empty table gives an empty one; other columns aren't read; a very long text is a slice of
its own.
"""

from __future__ import annotations

import hashlib
import json
import os
import string
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tiktoken import _tiktoken

from .common import held, slices

TABLE_ROWS, PIECE_ROWS = 250_000, 60_000
SLICE = 4 << 20
LONG_PIECE = 192
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MARKS = string.punctuation
_UNSEEN = object()
_PACK = [struct.Struct(f"<{n}I").pack for n in range(LONG_PIECE + 2)]
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def byte_alphabet() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class _Table(dict):
    """Word -> value, filled by ``make`` on first sight; of PIECE_ROWS words it starts anew, with the last as reserve."""

    def __init__(self, make):
        super().__init__()
        self.make, self.reserve = make, {}

    def __missing__(self, word):
        value = self.reserve.pop(word, _UNSEEN)
        if value is _UNSEEN:
            value = self.make(word)
        if len(self) >= PIECE_ROWS:
            self.reserve = dict(self)
            self.clear()
        self[word] = value
        return value


class Codec:
    """One vocabulary file, with its tables. ``ids`` of a text are those of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_level = pre["type"] == "ByteLevel"
        own = pre if self.byte_level else pre.get("pretokenizers", [{}])[-1]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.ending = model.get("end_of_word_suffix") or ""
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not plain or own.get("type") != "ByteLevel" or own["add_prefix_space"] or kinds not in ([], ["NFC", "Replace", "Lowercase"]) or self.byte_level == bool(self.ending):
            raise ValueError(f"{path}: not a vocabulary of a kind that is supported")
        self.lower = bool(kinds)
        vocab = model["vocab"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(set(made)):
            raise ValueError(f"{path}: the order of ids is not that of the merges")
        back = {chr(c): b for b, c in byte_alphabet().items()}
        # a byte that no text holds stands for the end of a word
        self.end = b"\xff" if self.ending else b""
        ranks, size = {}, 1 + max(max(vocab.values()), *self.special.values(), 0)
        pieces, decimals = [b""] * size, [b",%d" % i for i in range(size)]
        for piece, i in vocab.items():
            if piece not in self.special:
                letters = piece.removesuffix(self.ending) if self.ending else piece
                raw = bytes(back[c] for c in letters)
                ranks[raw + self.end * (letters != piece)] = i
                pieces[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else b""
        for content, i in self.special.items():
            pieces[i] = content.encode()
        self.ranks = _tiktoken.CoreBPE(ranks, {}, r"\S+")
        self.known = np.zeros(size, bool)
        self.known[[*vocab.values(), *self.special.values()]] = True
        self.pieces, self.decimals = pa.array(pieces, pa.large_binary()), pa.array(decimals, pa.large_binary())
        self.of_piece = _Table(self._piece)
        self.words, self.word_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self._model = None

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        if len(raw) <= LONG_PIECE:
            ids = self.ranks.encode_single_piece(raw + self.end)
            return _PACK[len(ids)](*ids)
        if self._model is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._model = Tokenizer.from_file(self.path).model
        ids = [t.id for t in self._model.tokenize(raw.decode("latin-1").translate(byte_alphabet()))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _normal(self, text: str) -> str:
        if not self.lower:
            return text
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return (text.replace("Σ", "σ") if "Σ" in text else text).lower()

    def _any(self, text: str) -> bytes:
        """Ids of any text by the full pattern, from the table of pieces."""
        out: list[bytes] = []
        pattern = BYTE_PATTERN if self.byte_level else WORD_PATTERN
        for part in self.split_special.split(text) if self.split_special and any(t in text for t in self.special) else (text,):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                out += map(self.of_piece.__getitem__, pattern.findall(self._normal(part)))
        return b"".join(out)

    def _word_ids(self, words: list[str]) -> list[bytes | None]:
        """Ids of words behind a space; None for white space in byte-level vocabularies, which may join with its neighbours."""
        out, piece, space = [], self.of_piece, " " * self.byte_level
        for word in words:
            if word.isalpha():
                core = self._normal(word) if self.lower else word
                out.append(piece[space + core] if core.isalpha() else self._any(space + word))
                continue
            core = self._normal(word.strip(MARKS))
            if not core.isalpha() or (not space and word[0] == "'") or any(t in word for t in self.special):
                out.append(None if space and (not word or word.isspace()) else self._any(space + word))
                continue
            # letters between marks: one piece for each
            first, last = word[: len(word) - len(word.lstrip(MARKS))], word[len(word.rstrip(MARKS)) :]
            ids = piece[space + first] + piece[core] if first else piece[space + core]
            out.append(ids + piece[last] if last else ids)
        return out

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a text column, one row after the other, and where each row's ids begin and end."""
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
        lists = pc.split_pattern(texts, " ")
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        words = lists.flatten()
        coded = words.dictionary_encode()
        own = coded.dictionary
        at = pc.index_in(own, value_set=self.words)
        new = own.filter(at.is_null())
        at = np.asarray(at.fill_null(-1)).astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, new])
        self.word_ids = pa.concat_arrays([self.word_ids, pa.array(self._word_ids(new.to_pylist()), pa.large_binary())])
        table, places = self.word_ids.take(pa.array(at)), np.asarray(coded.indices)
        if len(self.words) > TABLE_ROWS:
            self.words, self.word_ids = own, table
        if self.byte_level and len(texts):
            # a row's first word has no space in front
            first = words.take(pa.array(ends[:-1])).dictionary_encode()
            places = places.copy()
            places[ends[:-1]] = len(table) + np.asarray(first.indices)
            table = pa.concat_arrays([table, pa.array(map(self._any, first.dictionary.to_pylist()), pa.large_binary())])
        joined = table.take(pa.array(places))
        raw, bounds = _bytes(joined)
        ids, bounds = np.frombuffer(raw, "<u4", bounds[-1] // 4), bounds[ends] // 4
        if joined.null_count:
            odd = np.cumsum(np.append(0, np.asarray(joined.is_null())))[ends]
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            for i in np.flatnonzero(np.diff(odd)).tolist():
                parts[i] = np.frombuffer(self._any(texts[i].as_py()), "<u4")
            ids, bounds = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, bounds

    def ids(self, text: str | None) -> list[int]:
        return self.ids_of(pa.array([text or ""]))[0].tolist()

    def texts_of(self, ids: np.ndarray) -> tuple[pa.Buffer | bytes, np.ndarray]:
        """The bytes of the pieces of ``ids``, joined, and where each piece ends, from 0 on."""
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id that the vocabulary doesn't have")
        return _bytes(self.pieces.take(pa.array(ids)))


def _bytes(taken: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The joined bytes of a binary array and its offsets."""
    at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    return memoryview(taken.buffers()[2] if len(taken) and taken.buffers()[2] is not None else b""), at


def codec(path: str) -> Codec:
    """The worker's codec of a file."""
    return held(f"codec {path}", lambda: Codec(path))


def encode(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids (array<int>) and n_tokens of every whole text."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches):
        c = codec(path)
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                ids, at = c.ids_of(b.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(np.diff(at))], ["doc_id", "ids", "n_tokens"])

    return df.select(df[key].cast("long"), df[text]).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); a null list gives an empty text, an unknown id an error."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = []
            for ids in b.column(1):
                raw, _ = c.texts_of(np.asarray(ids.values if ids.is_valid else [], np.int64))
                texts.append(bytes(raw).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(df["doc_id"].cast("long"), df["ids"]).mapInArrow(run, "doc_id long, text string")


def round_trip_digest(df: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode, digest, decode and digest every text in one pass, without keeping ids."""
    path = path or default_path("byte_bpe_50k.json")

    def run(batches):
        c = codec(path)
        for b in batches:
            for i, j in slices(b.column(1), SLICE):
                ids, at = c.ids_of(b.column(1).slice(i, j - i))
                decimals, d = _bytes(c.decimals.take(pa.array(ids)))
                pieces, p = c.texts_of(ids)
                ids_sha, text_sha = [], []
                for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
                    ids_sha.append(hashlib.sha256(decimals[d[first] + 1 : d[last]] if last > first else b"").hexdigest())
                    raw = bytes(pieces[p[first] : p[last]])
                    text_sha.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [x.split()[0] for x in DIGESTS.split(", ")])

    return df.select(df[key].cast("long"), df[text]).mapInArrow(run, DIGESTS)
