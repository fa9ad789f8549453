"""Token ids of texts by a public byte-level BPE vocabulary, and fixed-length pieces of documents."""

from __future__ import annotations

import functools
import json
import re

import tiktoken

#: How byte-level BPE files split a text before the merges (fixed pattern of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level files write each byte as a printable character: itself if printable in Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE file of `tokenizers`; once a process. A file's added tokens are found in texts, as there."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    to_byte = _byte_of()
    special = {x["content"]: x["id"] for x in file["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _long_blanks(least: int) -> re.Pattern[str]:
    """Runs of white space of the pattern's kind: Unicode's, without the control characters that Python's own class has besides."""
    return re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{least},}}")


#: White space of this many characters or more is split off by hand: the pattern looks ahead behind a run, and its engine's stack is
#: too small for a million.
BLANKS = _long_blanks(10_000)


def _encoded(path: str, text: bytes, special: bool) -> list[int]:
    """As the pattern would split: a run is one piece up to its last character, which goes with what follows; all of it where
    nothing follows, or the name of an added token."""
    enc, whole = encoding(path), text.decode("utf-8", "replace")
    some = (lambda x: enc.encode(x, allowed_special="all")) if special else enc.encode_ordinary
    names = tuple(enc.special_tokens_set) if special else ()
    out, at = [], 0
    for run in BLANKS.finditer(whole):
        end = run.end() if run.end() == len(whole) or whole.startswith(names, run.end()) else run.end() - 1
        if run.start() > at:
            out += some(whole[at : run.start()])
        out += enc._encode_single_piece(whole[run.start() : end])
        at = end
    return out + some(whole[at:]) if out else some(whole)


def encode(path: str, text: bytes) -> list[int]:
    return _encoded(path, text, True)


def encode_ordinary(path: str, text: bytes) -> list[int]:
    """As encode, but the names of added tokens are ordinary text."""
    return _encoded(path, text, False)
