"""Token ids of whole texts by a tokenizer file of the tokenizers library.

Two kinds of file are known: byte-level BPE, and BPE over lower-cased words with a mark at each word's end. Their
vocabulary is given to tiktoken, which merges the same pairs in the same order several times faster and keeps no
cache that grows with the text; a word's end is then a byte of its own, which no such text holds. Other files, and texts
beyond what is known to be equal, go to the tokenizers library itself, so the ids are always that library's.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

from gridloom.llm.common import kept_by_process

#: Characters of a text that is split and lower-cased here: ASCII but most control characters, and letters of Latin-1.
_KNOWN = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: Of a byte of such a text in lower case: 0 white space, 1 of a letter, 2 a digit, 3 another character.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_KIND[ord("0"):ord("9") + 1] = 2
_SPACE = re.compile(r"\s", re.ASCII)
END = "\x01"
#: Characters of text that are split at once.
BLOCK = 1 << 20

# What a word-level file does before merging.
_WORD_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD_SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_BYTE_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def word_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary: itself, or one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class FileTokenizer:
    """Ids of whole texts; ``special`` strings of the file are found in texts, as the library does by default."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.slow, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        odd = any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        odd = odd or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "byte_fallback"))
        ends = model.get("end_of_word_suffix") or ""
        self.words = spec.get("normalizer") == _WORD_NORMALIZER and spec.get("pre_tokenizer") == _WORD_SPLIT and ends != ""
        if not odd and (self.words or spec.get("normalizer") is None and spec.get("pre_tokenizer") == _BYTE_SPLIT and not ends):
            self.fast = self._merger(model, ends)

    def _merger(self, model: dict, ends: str):
        import public_tokenizers
        import tiktoken
        byte, vocab = _bytes_of_characters(), model["vocab"]

        def raw(token: str) -> bytes:
            last = bool(ends) and token.endswith(ends)
            return bytes(byte[c] for c in (token[:-len(ends)] if last else token)) + END.encode() * last

        merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        # First the bytes, then the bytes that end a word, then what merging makes, in its order.
        order = [*(c for c in byte if c in vocab), *(c + ends for c in byte if ends and c + ends in vocab), *merged]
        ranks = {raw(t): i for i, t in enumerate(dict.fromkeys(order))}
        self.ids = np.array([vocab[t] for t in dict.fromkeys(order)], np.uint32)
        pattern = f"[^{END}]+{END}" if self.words else public_tokenizers.PATTERN
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        known = self.fast is not None and not any(s in text for s in self.special) and (not self.words or _KNOWN.fullmatch(text))
        try:
            if known and self.words:
                return np.concatenate([np.zeros(0, np.uint32), *map(self._words, _blocks(text))])
            if known:
                return self.ids[self.fast.encode_to_numpy(text)]
        except ValueError:  # a run of white space longer than the pattern's stack
            pass
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, text: str) -> np.ndarray:
        marked = _with_ends(np.frombuffer(text.lower().encode(), np.uint8))
        return self.ids[self.fast.encode_to_numpy(marked)] if marked else np.zeros(0, np.uint32)

    def encode_bytes(self, raw: bytes) -> np.ndarray:
        return self.encode(raw.decode("utf-8", "replace"))


def _with_ends(text: np.ndarray) -> str:
    """A lower-case text without white space, END after each word: runs of letters, of other characters, and single digits.

    An apostrophe that begins a run, and the letters s, t, re, ve, m, ll or d after it, are a word of their own.
    """
    if not len(text):
        return ""
    kind = _KIND[text]
    last = np.append(kind[1:] != kind[:-1], True)
    last = (last | (kind == 2)) & (kind != 0)
    quotes = np.flatnonzero(text == ord("'"))
    if len(quotes):
        quotes = quotes[(quotes == 0) | (kind[quotes - 1] != 3)]
        after = np.append(text, [0, 0])
        first, second = after[quotes + 1], after[quotes + 2]
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        one = np.isin(first, list(b"stmd"))
        quotes, ends = quotes[one | two], (quotes + 1 + two)[one | two]
        last[quotes] = False
        last[ends] = True
    kept = np.flatnonzero(kind)
    ends = last[kept]
    out = np.full(len(kept) + int(ends.sum()), ord(END), np.uint8)
    out[np.arange(len(kept)) + np.cumsum(ends) - ends] = text[kept]
    return out.tobytes().decode()


def _blocks(text: str) -> Iterator[str]:
    """The text cut at white space, where no word goes on."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + BLOCK)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def tokenizer(path: str) -> FileTokenizer:
    """One per worker process, whatever the number of its tasks."""
    return kept_by_process(f"tokenizer {path}", lambda: FileTokenizer(path))
