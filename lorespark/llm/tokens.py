"""Operator 5: token counts by the whole-token shortcut, and the encoder that operator 3 shares."""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import small_batches

#: Bytes that a worker's memory of chunks may take, and that of pre-tokens beside the proven ones: the first that it
#: meets. Each entry counts ENTRY bytes besides its own; longer ones than LONGEST are never kept. Results don't depend on it.
MEMO, ENTRY, LONGEST = 48 << 20, 200, 64
#: Pre-tokens that one call of the library encodes: it holds some hundred bytes for each byte of its input.
CALL = 2000
#: Unseen chunks that are taken apart at once.
PART = 1 << 12
LIMIT = 2048
#: Texts without any of these have a plain normal form: lower case of each character, nothing to compose.
_BEYOND = re.compile("[^\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u024f]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary of this name is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encode text with a BPE tokenizer file whose pre-tokenizer drops white space, pre-token by pre-token.

    Such a tokenizer treats pre-tokens apart from each other, and the chunks between ASCII white space too: its
    normalizer maps white space to a blank, its pre-tokenizer splits there, and no added token holds or strips any.
    ``separable`` checks these conditions in the file; where they don't hold, whole texts go to the library.
    Chunks with special strings, or with characters whose normal form isn't plain, go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        # one call at a time: the library's thread pool would only take cores from other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.separable, self.split, self.end = self._read(path)
        self.proven: dict[str, int] = self._prove() if self.separable else {}
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for s, i in vocab.items() if self.end and s.endswith(self.end)]] = True
        self.ids: dict[str, bytes] = {p: np.uint32(i).tobytes() for p, i in self.proven.items()}
        self.chunks: dict[str, bytes] = {}
        self.counts: dict[str, int] = dict.fromkeys(self.proven, 1)
        self.sizes: dict[str, int] = {}
        self.room = {id(x): MEMO for x in (self.ids, self.chunks, self.counts, self.sizes)}
        self.split_lines = regex.compile(f"{self.split.pattern}|\n") if self.separable else None

    @staticmethod
    def _read(path: str) -> tuple[bool, regex.Pattern | None, str]:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        rule = steps[0].get("pattern", {}).get("Regex") if steps and steps[0].get("type") == "Split" else None
        norm = spec.get("normalizer") or {}
        kinds = [x.get("type") for x in norm.get("normalizers", [norm])]
        end = spec["model"].get("end_of_word_suffix") or ""
        ok = bool(rule) and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and [s.get("type") for s in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True)
        ok = ok and kinds == ["NFC", "Replace", "Lowercase"] and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and bool(end)
        ok = ok and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in spec["added_tokens"])
        ok = ok and not any(regex.search(rule, c) for c in " \t\n\r\x0b\x0c")
        # each byte alone must be a token that ends a word, so that a pre-token's last token always does
        ok = ok and sum(len(s) == 1 + len(end) and s.endswith(end) for s in spec["model"]["vocab"]) >= 256
        return bool(ok), regex.compile(rule) if ok else None, end

    def _prove(self) -> dict[str, int]:
        """Vocabulary strings that, as a pre-token of their own, encode as exactly one token: tried one by one."""
        own = [s.removesuffix(self.end) for s in self.lib.get_vocab(with_added_tokens=False) if s.endswith(self.end)]
        # byte-level letters stand for bytes: only strings that are their own byte-level form are looked at
        own = [s for s in dict.fromkeys(own) if s and s.isascii() and s == s.lower() and self.split.fullmatch(s)]
        return {s: e.ids[0] for s, e in zip(own, self.lib.encode_batch_fast(own, add_special_tokens=False), strict=True) if len(e.ids) == 1}

    def _merge(self, new: list[str]) -> dict[str, bytes]:
        """Ids of unseen pre-tokens, each <u4: encoded in one call, cut after each id that ends a pre-token."""
        rare = [p for p in new if p[0] == "\t"]
        plain = [p for p in new if p[0] != "\t"] if rare else new
        out = {}
        if rare:
            out.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(rare, self.lib.encode_batch_fast([p[1:] for p in rare], add_special_tokens=False), strict=True))
        for some in (plain[i : i + CALL] for i in range(0, len(plain), CALL)):
            flat = np.array(self.lib.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[flat]) + 1)).tolist()
            if len(ends) != len(some) or ends[-1] != 4 * len(flat):
                raise ValueError("pre-tokens and their ids don't agree")
            raw, at = flat.tobytes(), 0
            for p, e in zip(some, ends, strict=True):
                out[p] = raw[at:e]
                at = e
        return out

    def _pretokens(self, chunks: list[str]) -> list[str]:
        """Pre-tokens of these chunks, each chunk's followed by a line feed. A chunk that only the library can take stands
        as one pre-token, after a tab."""
        text = "\n".join(chunks)
        if not (_BEYOND.search(text) or "<|" in text):
            return [*self.split_lines.findall(text.lower()), "\n"]
        pre: list[str] = []
        for c in chunks:
            pre += ["\t" + c] if _BEYOND.search(c) or "<|" in c else self.split.findall(c.lower())
            pre.append("\n")
        return pre

    def _learn(self, chunks: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of each of these chunks, end to end and their sizes in bytes: what is known of their pre-tokens and a few
        calls for the rest."""
        memo = self.ids
        pre = self._pretokens(chunks)
        got = list(map(memo.get, pre))
        new = self._merge(list({p for p, v in zip(pre, got, strict=True) if v is None} - {"\n"}))
        new["\n"] = b""
        got = [new[p] if v is None else v for p, v in zip(pre, got, strict=True)]
        del new["\n"]
        self._keep(memo, new.items())
        upto = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        ends = upto[np.fromiter((p == "\n" for p in pre), bool, len(pre))]
        return b"".join(got), np.diff(ends, prepend=0)

    def _weigh(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each of these chunks: 1 for each proven pre-token; the others are merged and their ids counted."""
        memo = self.counts
        pre = self._pretokens(chunks)
        got = list(map(memo.get, pre))
        new = {p: len(x) // 4 for p, x in self._merge(list({p for p, v in zip(pre, got, strict=True) if v is None} - {"\n"})).items()}
        n = np.fromiter((v if v is not None else new[p] if p != "\n" else 0 for p, v in zip(pre, got, strict=True)), np.int64, len(pre))
        self._keep(memo, new.items())
        return np.diff(np.cumsum(n)[np.fromiter((p == "\n" for p in pre), bool, len(pre))], prepend=0)

    def _keep(self, memo: dict, new: Iterable[tuple[str, bytes | int]]) -> None:
        """Fill the memory up to its bytes; what is common is met early, so what is there stays."""
        room = self.room[id(memo)]
        for k, v in new:
            if room <= 0:
                break
            if len(k) <= LONGEST:
                memo[k] = v
                room -= ENTRY + len(k) + (len(v) if isinstance(v, bytes) else 0)
        self.room[id(memo)] = room

    def _known(self, chunks: list[str], memo: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these distinct chunks: all end to end, where each chunk's begin, and how many they are."""
        got = list(map(memo.get, chunks))
        unseen = np.fromiter((v is None for v in got), bool, len(got))
        fresh = [c for c, v in zip(chunks, got, strict=True) if v is None]
        old = b"".join([v for v in got if v is not None])
        size = np.zeros(len(got), np.int64)
        size[~unseen] = np.fromiter((len(v) for v in got if v is not None), np.int64, len(got) - len(fresh))
        first = np.zeros(len(got), np.int64)
        first[~unseen] = np.cumsum(size[~unseen]) - size[~unseen]
        raw = b""
        del got
        if fresh:
            parts = [self._learn(fresh[i : i + PART]) for i in range(0, len(fresh), PART)]
            raw, sizes = b"".join(x for x, _ in parts), np.concatenate([x for _, x in parts])
            del parts
            size[unseen] = sizes
            at = np.cumsum(sizes) - sizes
            first[unseen] = at + len(old)
            self._keep(memo, ((c, raw[i : i + n]) for c, i, n in zip(fresh, at.tolist(), sizes.tolist(), strict=True)))
        return np.frombuffer(old + raw, "<u4"), first // 4, size // 4

    @staticmethod
    def _chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct chunks of some texts, for each chunk its number, and where each text's chunks start (one more: the end)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.flatten().dictionary_encode()
        starts = lists.offsets.to_numpy()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), starts - starts[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts end to end (<u4), and where each text's ids start (one more: the end)."""
        if not self.separable:
            each = [np.array(self.lib.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        words, at, starts = self._chunks(texts)
        flat, first, size = self._known(words, self.chunks)
        del words
        ends = np.concatenate([[0], np.cumsum(size[at])])
        ids, shift = np.empty(ends[-1], "<u4"), first[at] - ends[:-1]
        for i in range(0, len(at), 1 << 17):  # the places of some chunks' ids at once
            part = slice(i, i + (1 << 17))
            a, b = ends[i], ends[min(i + (1 << 17), len(at))]
            ids[a:b] = flat[np.repeat(shift[part], size[at[part]]) + np.arange(a, b)]
        return ids, ends[starts]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: proven pre-tokens count one each, only the others are merged."""
        if not self.separable:
            return np.array([len(self.lib.encode(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()], np.int64)
        words, at, starts = self._chunks(texts)
        size = np.fromiter((self.sizes.get(c, -1) for c in words), np.int64, len(words))
        if (unseen := np.flatnonzero(size < 0)).size:
            fresh = [words[i] for i in unseen.tolist()]
            size[unseen] = np.concatenate([self._weigh(fresh[i : i + PART]) for i in range(0, len(fresh), PART)])
            self._keep(self.sizes, zip(fresh, size[unseen].tolist(), strict=True))
        return np.diff(np.concatenate([[0], np.cumsum(size[at])])[starts])


def give_back() -> None:
    """Free memory of Arrow's pool and of the C library goes back to the system, where that is known how to."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes in a column: enough for few distinct chunks, and no more than
    that and one row. What a batch took is given back before the next is read."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole() -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()
        give_back()

    for b in batches:
        upto = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < b.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = min(b.num_rows, int(np.searchsorted(upto, before + most - size, "left")) + 1)
            held.append(b.slice(at, end - at))
            size += int(upto[end - 1]) - before
            at = end
            if size >= most:
                yield from whole()
                size = 0
    if held:
        yield from whole()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every whole text; null and empty texts have 0 bytes and tokens.

    One narrow pass without a shuffle. Rows keep their ids, repeated or null; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in gathered(batches, 1):
            n = enc.count(b.column(1))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
