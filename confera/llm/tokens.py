"""Token ids of whole texts as little-endian 32-bit bytes, all of them from the tokenizers library, in batches.

Where a tokenizer drops white space and no token crosses it, the ids of a text are those of its words one after the other;
then the library encodes each distinct word of a batch once, and a worker remembers its ids. Whether that holds is read from
the tokenizer's own description (`white_space_apart`); any other tokenizer gets the texts whole. Of texts of printable ASCII
and Latin-1 letters the words are cut further, at the places where the tokenizer's own pattern cuts them, as there are far
fewer distinct pieces than words. Where the tokenizer marks the last token of a piece, the library gets new pieces a
hundred to a text, as most of its time goes into the texts' number; pieces whose ids don't show their ends get texts of their own.

Defined results: a null or empty text has no ids. Strings of special tokens within a text count as those tokens. A very long
text is encoded as a whole. The memory of words is bounded and starts anew when full.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: Words and pieces that a worker remembers, about 150 MB.
REMEMBERED = 700_000
#: New pieces that the library gets as one text.
TOGETHER = 100

#: Patterns of pieces that hold no white space, of tokenizers that drop what is between the pieces; each with
#: the same pattern over lower-case plain text.
APART = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+": re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")}
_NOT_PLAIN = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ÿ]")
#: Words that are one piece whatever stands beside them. None holds both a letter and `<`, so no token within one ends with END.
_ONE_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
#: The mark of the last token of a piece.
END = "</w>"


def _parts(spec: dict | None, many: str) -> list[dict]:
    return [] if spec is None else spec[many] if spec["type"] == "Sequence" else [spec]


def white_space_apart(spec: dict) -> bool:
    """spec: a tokenizer's JSON. Whether encoding words apart gives the ids of the whole text."""
    normal, pre = _parts(spec["normalizer"], "normalizers"), _parts(spec["pre_tokenizer"], "pretokenizers")
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" and n["content"] == " " for n in normal)
    first = pre[0] if pre else {"type": None}
    cut = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") in APART
    bytes_only = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]]) for t in spec["added_tokens"])
    return plain and cut and bytes_only and added and spec["post_processor"] is None


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker on each core already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.apart = white_space_apart(spec)
        self.lower = any(n["type"] == "Lowercase" for n in _parts(spec["normalizer"], "normalizers"))
        self.piece = APART[_parts(spec["pre_tokenizer"], "pretokenizers")[0]["pattern"]["Regex"]] if self.apart and self.lower else None
        self.special = [t["content"].lower() for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.ends = None  # by id, whether it ends a piece
        if self.piece is not None and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == END:
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for token, i in vocab.items() if token.endswith(END)]] = True

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def apart_from_others(self, words: Sequence[str]) -> dict[str, bytes]:
        """The ids of each word."""
        if self.ends is None:
            return dict(zip(words, self.whole(words)))
        ones, others, out = [], [], {}
        for w in words:
            (ones if _ONE_PIECE.fullmatch(w) else others).append(w)
        parts = [ones[at : at + TOGETHER] for at in range(0, len(ones), TOGETHER)]
        for part, raw in zip(parts, self.whole([" ".join(part) for part in parts])):
            ends = (4 * np.flatnonzero(self.ends[np.frombuffer(raw, dtype="<u4")]) + 4).tolist()
            # A piece has one end at most: of as many ends as pieces, each has its own.
            if len(ends) == len(part) and ends[-1] == len(raw):
                out.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends))))
            else:
                others += part
        out.update(zip(others, self.whole(others)))
        return out

    def _pieces(self, text: str) -> list[str]:
        if self.piece is not None and not _NOT_PLAIN.search(text):
            low = text.lower()
            if not any(t in low for t in self.special):
                return self.piece.findall(low)
        return [w.decode() for w in text.encode().split()]  # at ASCII white space only

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text, without special tokens, as little-endian unsigned 32-bit numbers."""
        if not self.apart:
            return self.whole([t or "" for t in texts])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, split = self.known, [self._pieces(t) if t else [] for t in texts]
        new = [w for w in set().union(*split) if w not in known]
        if new:
            known.update(self.apart_from_others(new))
        return [b"".join([known[w] for w in pieces]) for pieces in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; it outlives a task, and so does what it remembers."""
    return Encoder(path)
