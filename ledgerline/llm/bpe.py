"""BPE encoding and decoding by forced boundaries, for vocabularies of the ``tokenizers`` JSON kind.

A byte pair that stands inside no token of the vocabulary can never be merged, so between its bytes there is
certainly a cut. White space, the pattern of the vocabulary's splitter and such pairs cut a text into fragments, each
is encoded alone, and the ids are concatenated. Fragments repeat, so a worker keeps tables of them, bounded in entries
and in bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from ledgerline.llm.common import text_batches

KEPT_WORDS, KEPT_BYTES, ENTRY_BYTES, LONG_FRAGMENT = 300_000, 32 << 20, 200, 40
#: What Unicode calls white space, and four control characters that only Python takes for it.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE, ODD_SPACE = regex.compile(f"[{WHITE}]+"), regex.compile("[" + "".join(map(chr, range(0x1C, 0x20))) + "]")
#: Letters up to here (Latin) have meant the same in every version of Unicode that the libraries follow.
SETTLED = regex.compile(f"[!-~{chr(0xA1)}-{chr(0x24F)}]*")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand
    for themselves, the others take the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def _tokens(spec: dict) -> list[str]:
    """The token of each id, special ones included."""
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        tokens[i] = token
    return tokens


class Kept(dict):
    """Ids by text, to be forgotten as a whole once there are too many entries or bytes."""

    held = 0

    def full(self, more: int = 0) -> bool:
        return len(self) + more > KEPT_WORDS or self.held > KEPT_BYTES

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def learn(self, new: dict[str, bytes]) -> None:
        self.update(new)
        self.held += sum(map(len, new)) + sum(map(len, new.values())) + ENTRY_BYTES * len(new)


class Codec:
    """Vocabulary, merges and the byte pairs that occur inside tokens, read from one JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([self.vocab[p[side]] for p in pairs], np.int64) for side in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys)  # for looking up the ranks of many pairs at once
        self.keys, self.key_rank = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, len(pairs)).astype(np.int32)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(split)
        # Beyond that, versions of Unicode differ between libraries; the file's own normaliser and splitter decide.
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = Split(Regex(split), "removed", invert=True)
        self.tokens = _tokens(spec)
        inside = set()
        for token in self.vocab:
            body = token.removesuffix(self.end)
            inside.update(zip(body, body[1:], strict=False))
        self.inside = inside
        self.single, self.single_end = (np.zeros(512, np.int32) for _ in range(2))
        for letter in self.letters:
            self.single[ord(letter)], self.single_end[ord(letter)] = self.vocab[letter], self.vocab[letter + self.end]
        self.words, self.pieces = Kept(), Kept()

    def fragments(self, letters: str) -> list[str]:
        """``letters`` cut wherever two neighbours stand together inside no token."""
        if self.inside.issuperset(zip(letters, letters[1:], strict=False)):
            return [letters]
        cuts = [0, *(i for i in range(1, len(letters)) if (letters[i - 1], letters[i]) not in self.inside), len(letters)]
        return [letters[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def merged_by_heap(self, symbols: list[str]) -> list[str]:
        """The merges of lowest rank first, leftmost first among equals; for one long fragment."""
        ids = [self.vocab[s] for s in symbols]
        n, none = len(ids), len(self.made)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ranks = self._ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)

        def meet(i: int, j: int) -> None:
            key = ids[i] << 32 | ids[j]
            at = self.keys.searchsorted(key)
            if self.keys[at] == key:
                heapq.heappush(heap, (int(self.key_rank[at]), i, ids[i], ids[j]))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                meet(i, k)
            if (h := before[i]) >= 0:
                meet(h, i)
        return [self.tokens[x] for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.key_rank[at], len(self.made))

    def merged_together(self, symbols: np.ndarray) -> list[bytes]:
        """The same for many fragments of one length, a row of ids each: every round merges the best pair of every
        row, so all rows that go on are one shorter."""
        out: list[bytes] = [b""] * len(symbols)
        row = np.arange(len(symbols))
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while len(row):
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            rank = ranks[np.arange(len(row)), best] if ranks.shape[1] else np.full(len(row), len(self.made))
            over = rank == len(self.made)
            for k, ids in zip(row[over].tolist(), symbols[over], strict=True):
                out[k] = ids.tobytes()
            row, symbols, ranks, best, rank = (v[~over] for v in (row, symbols, ranks, best, rank))
            n, width = symbols.shape
            if not n:
                break
            each, places = np.arange(n), np.arange(width)
            symbols[each, best] = self.made[rank]
            symbols = symbols[places != best[:, None] + 1].reshape(n, width - 1)
            ranks = ranks[places[:-1] != best[:, None]].reshape(n, width - 2)
            follows, leads = np.flatnonzero(best < width - 2), np.flatnonzero(best > 0)
            ranks[follows, best[follows]] = self._ranks(symbols[follows, best[follows]], symbols[follows, best[follows] + 1])
            ranks[leads, best[leads] - 1] = self._ranks(symbols[leads, best[leads] - 1], symbols[leads, best[leads]])
        return out

    def _encode_fragments(self, fragments: list[tuple[str, bool]]) -> list[bytes]:
        """Ids of fragments; the flag tells that a fragment ends its piece."""
        out: list[bytes] = [b""] * len(fragments)
        by_length: dict[int, list[int]] = {}
        for i, (letters, last) in enumerate(fragments):
            if len(letters) > LONG_FRAGMENT:
                symbols = [*letters]
                symbols[-1] += self.end if last else ""
                out[i] = array("i", [self.vocab[s] for s in self.merged_by_heap(symbols)]).tobytes()
            else:
                by_length.setdefault(len(letters), []).append(i)
        for length, own in by_length.items():
            code = np.frombuffer("".join([fragments[i][0] for i in own]).encode("utf-32-le"), np.uint32).reshape(-1, length)
            symbols, last = self.single[code], np.array([fragments[i][1] for i in own])
            symbols[last, -1] = self.single_end[code[last, -1]]
            for i, ids in zip(own, self.merged_together(symbols), strict=True):
                out[i] = ids
        return out

    def _learn_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids, as packed 32-bit integers, of pieces of the splitter."""
        fragments, ends = [], []
        for piece in pieces:
            letters = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode("utf-8", "replace")])
            *heads, tail = self.fragments(letters)
            fragments += [*((head, False) for head in heads), (tail, True)]
            ends.append(len(fragments))
        ids = self._encode_fragments(fragments)
        return {piece: b"".join(ids[a:b]) for piece, a, b in zip(pieces, [0, *ends], ends, strict=False)}

    def _pieces_of(self, word: str) -> list[str]:
        if SETTLED.fullmatch(word):
            return self.piece.findall((word if word.isascii() else unicodedata.normalize("NFC", word)).lower())
        return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word))]

    def encode_words(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each list of words without white space. White space neither joins nor reorders with its neighbours
        under normalisation, so words can be normalised one by one."""
        new = set().union(*texts).difference(self.words)
        if self.words.full(len(new)):
            self.words.forget()
            new = set().union(*texts)
        if new:
            split = {word: self._pieces_of(word) for word in new}
            wanted = {p for pieces in split.values() for p in pieces}
            if self.pieces.full(len(wanted)):
                self.pieces.forget()
            self.pieces.learn(self._learn_pieces(wanted.difference(self.pieces)))
            known = self.pieces.__getitem__
            self.words.learn({word: b"".join(map(known, pieces)) for word, pieces in split.items()})
        known = self.words.__getitem__
        out = [b"".join(map(known, words)) for words in texts]
        if self.words.full():  # one batch alone may hold more
            self.words.forget()
            self.pieces.forget()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as packed 32-bit integers."""
        plain, plan = [], []
        for text in texts:
            at, parts = 0, []
            for found in self.special_at.finditer(text):
                parts += [len(plain), array("i", [self.special[found[0]]]).tobytes()]
                plain.append(words_of(text[at:found.start()]))
                at = found.end()
            plan.append([*parts, len(plain)])
            plain.append(words_of(text[at:] if at else text))
        ids = self.encode_words(plain)
        return [b"".join([p if isinstance(p, bytes) else ids[p] for p in parts]) for parts in plan]


def words_of(text: str) -> list[str]:
    return [w for w in SPACE.split(text) if w] if ODD_SPACE.search(text) else text.split()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per Python worker and vocabulary."""
    return Codec(path)


@lru_cache(maxsize=2)
def token_texts(path: str) -> pa.Array:
    """The token of each id; all that decoding needs of a vocabulary."""
    with open(path, encoding="utf-8") as file:
        return pa.array(_tokens(json.load(file)), pa.large_string())


def _packed_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _added(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def _joined(tokens: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The texts that lists of ids decode to."""
    ends = pa.array(np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()]), pa.int32())
    own = pa.ListArray.from_arrays(ends, pc.take(tokens, ids.flatten()))
    return pc.binary_join(own, pa.scalar(" ", pa.large_string())).cast(pa.string())


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", drop_text: bool = False) -> DataFrame:
    """``df`` with the ids of every whole text as ``array<int>``.

    Null and empty texts have no ids. Strings of special tokens in a text become those tokens, as the public
    library does with ``add_special_tokens=False``. ``vocabulary`` is a path that every worker can open. A column
    already called ``ids_col`` is replaced; all other columns and rows are kept, ``text_col`` too unless ``drop_text``.
    """
    gone = {ids_col} | ({text_col} if drop_text else set())
    kept = [f for f in df.schema.fields if f.name not in gone]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 512):
                packed = own.encode([x.as_py() or "" for x in texts.slice(at, 512)])
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _packed_lists(packed)], [*names, ids_col])

    fed = text_batches(df).select(*[df[n] for n in names], df[text_col].alias("_llm_text"))
    return fed.mapInArrow(run, T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))]))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of ``ids_col``: the vocabulary names no decoder, so the tokens stand joined by
    one space, special tokens included. Null and empty ids give an empty text. ``out_col`` is replaced if present."""
    kept = [f for f in df.schema.fields if f.name != out_col]
    names = [f.name for f in kept]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_texts(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield _added(part, out_col, _joined(tokens, part.column(at)))

    return df.select(*[df[n] for n in names]).mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.StringType())]))


def round_trip(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``df`` without its text but with ``ids``, ``n_tokens``, ``decoded_sha256`` of the text that :func:`decode` makes of
    them and ``same_ids``, whether encoding that text gives the same ids. One worker a task does all three steps with
    one vocabulary, and decoded texts do not leave it. Columns of these names are replaced; null texts are empty."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.IntegerType()),
             T.StructField("decoded_sha256", T.StringType()), T.StructField("same_ids", T.BooleanType())]
    kept = [f for f in df.schema.fields if f.name not in {text_col, *(f.name for f in added)}]
    names = [f.name for f in [*kept, *added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = codec(vocabulary), token_texts(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                packed = own.encode([x.as_py() or "" for x in part.column(part.num_columns - 1)])
                ids = _packed_lists(packed)
                texts = _joined(tokens, ids).to_pylist()
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                same = [a == b for a, b in zip(packed, own.encode(texts), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], ids, pc.list_value_length(ids), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], names)

    fed = text_batches(df).select(*[df[f.name] for f in kept], df[text_col].alias("_llm_text"))
    return fed.mapInArrow(run, T.StructType([*kept, *added]))
