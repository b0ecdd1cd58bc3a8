"""Token ids of whole texts, as the public tokenizer library of a vocabulary file gives them."""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from array import array

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as little-endian unsigned 32-bit numbers")

#: A fixed value: the pattern by which byte-level BPE of this kind pre-tokenizes, with possessive repeats.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Scripts whose letters, digits and white space every Unicode version of use has the same.
_SETTLED = re.compile("[\x00-\u024f\u0370-\u0373\u0376-\u0377\u0391-\u03a1\u03a3-\u03ff\u0400-\u0481\u048a-\u0523\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff10-\uff19]*")
#: A run without white space so long that pairwise merging would be slow.
_LONG_RUN = re.compile(r"\S{1500}")


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else spare))
        spare += b not in printable
    return out


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Ids by bytes, if the file asks for plain byte-level BPE whose merges are in the order of their ids, else nothing."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or (spec.get("post_processor") or pre).get("type") != "ByteLevel":
        return None
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    byte = {c: b for b, c in enumerate(_byte_letters())}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    own = {k: i for k, i in model["vocab"].items() if k not in added}
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [own.get(m, -1) for m in made]
    if order != sorted(set(order)) or len(made) + 256 != len(own) or not all(c in byte for k in own for c in k):
        return None
    return {bytes(byte[c] for c in k): i for k, i in own.items()}


class Encoder:
    """``ids(text)`` gives a text's ids as little-endian unsigned 32-bit bytes, exactly as the library does.

    For a plain byte-level vocabulary the ids come from a faster implementation of the same merges. Texts with
    added tokens, with letters of scripts on which Unicode versions may differ, or with very long runs without
    white space go through the library itself, as do all texts of other vocabularies.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._fast, self._loaded, self.added = None, None, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._library = lambda text: model.encode(text, num_threads=1)
        else:
            self._library = lambda text: self._tokenizer(path).encode_batch_fast([text], add_special_tokens=False)[0].ids
            with open(path, encoding="utf-8") as f:
                self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
            ranks = merge_ranks(path)
            if ranks is not None:
                import tiktoken

                self._fast = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _tokenizer(self, path: str):
        """The library, loaded for the first text that needs it."""
        if self._loaded is None:
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_file(path)
            self._loaded.no_truncation()
            self._loaded.no_padding()
        return self._loaded

    def library(self, text: str) -> bytes:
        return array("I", self._library(text)).tobytes() if text else b""

    def ids(self, text: str) -> bytes:
        if self._fast is None or any(t in text for t in self.added) or not (text.isascii() or _SETTLED.fullmatch(text)) or _LONG_RUN.search(text):
            return self.library(text)
        return array("I", self._fast(text)).tobytes()


def encoder(path: str) -> Encoder:
    """The encoder of this worker process: later tasks of the process find it loaded."""
    held = sys.modules.setdefault("corpusloom_worker", types.ModuleType("corpusloom_worker"))
    known = held.__dict__.setdefault("encoders", {})
    if path not in known:
        known.clear()
        known[path] = Encoder(path)
    return known[path]
