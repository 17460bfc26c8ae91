"""Token ids and counts as the `tokenizers` library gives them."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from functools import lru_cache


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer, once a worker. Its own threads stay off: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def version_digest(path: str) -> str:
    """A digest of all that a count depends on besides the text: vocabulary file, library version and options."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{tokenizers.__version__}|plain".encode()).hexdigest()


def count(path: str, texts: list[str]) -> list[int]:
    return [len(x.ids) for x in library(path).encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def twin(path: str):
    """The same vocabulary as ranks, for a plain byte-level BPE whose merges stand in the order of their ids; else None.

    Its encoder gives the library's ids in less time.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    kind, model, added = told.get("pre_tokenizer") or {}, told["model"], {x["content"] for x in told.get("added_tokens") or []}
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or told.get("normalizer") or kind.get("type") != "ByteLevel" or not kind.get("use_regex") or kind.get("add_prefix_space"):
        return None
    import public_tokenizers
    import tiktoken

    # bytes that print stand for themselves in the vocabulary, the others for characters from 256 on
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printed)}
    ranks = {bytes(names[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merges]
    if order != sorted(order) or len(ranks) != 256 + len(merges):
        return None
    return tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Any character but those whose classes no Unicode version or library sees differently.
_RARE = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e]")


@lru_cache(maxsize=4)
def _added(path: str) -> re.Pattern:
    with open(path, encoding="utf-8") as f:
        return re.compile("|".join(re.escape(x["content"]) for x in json.load(f).get("added_tokens") or []) or r"(?!)")


def encode(path: str, texts: list[str]) -> list[bytes]:
    """Of each whole text, its ids as little-endian unsigned 32-bit bytes.

    Texts with rare characters or strings of added tokens, and all texts of other kinds of tokenizers, go to the library.
    """
    fast, added = twin(path), _added(path)
    out: list[bytes | None] = [None] * len(texts)
    rest = []
    for i, text in enumerate(texts):
        if fast and not _RARE.search(text) and not added.search(text):
            out[i] = array("I", fast.encode_ordinary(text)).tobytes()
        else:
            rest.append(i)
    for i, x in zip(rest, library(path).encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else (), strict=True):
        out[i] = array("I", x.ids).tobytes()
    return out
