"""Token ids of whole texts by a tokenizer file, with the ids of each blank-led stretch remembered.

A byte-level BPE of this family parts a text, before any merge, at every single space that a character other than white space
follows; nothing is merged across. So a text is the chain of its stretches ("word", " word", ...), each stretch is encoded
by the tokenizer once, and the text's ids are the stretches' ids one after another. Stretches that start with further white
space stay joined to the one before.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np

_WHITE_AFTER_SPACE = re.compile(r" (?=\s|$)")
_CUT = re.compile(r" (?=\S)")
# Fixed value: the pattern that byte-level BPE files of this family part text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches remembered by a worker before it starts anew; about 100 bytes each.
MOST_KEPT = 600_000


def same_ranks(path: str):
    """The file's own vocabulary as a rank table, which encodes the same ids several times faster. Only for a byte-level BPE
    with the usual pattern whose ids follow the order of its merges, without ignored merges or a prefix space; else nothing. Also the bytes that each id stands for."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    if (model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True)
            or spec.get("normalizer") or model.get("ignore_merges") or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges))):
        return None, None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = dict(zip(map(chr, printable), printable)) | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(chars[c] for c in t): k for t, k in model["vocab"].items() if t not in special}
    sizes = {k: len(t) for t, k in model["vocab"].items() if t not in special} | {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens", [])}
    n_bytes = np.zeros(1 + max(sizes), np.int64)
    n_bytes[list(sizes)] = list(sizes.values())
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), n_bytes


class Stretches:
    """A tokenizer with remembered stretches. ``spans``: character spans will be asked for."""

    def __init__(self, path: str, spans: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.ranks, self.n_bytes = same_ranks(path)
        self.with_offsets = spans and self.ranks is None
        self.first: dict[str, object] = {}
        self.led: dict[str, object] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    def cut(text: str) -> list[str]:
        return text.split(" ") if not _WHITE_AFTER_SPACE.search(text) else _CUT.split(text)

    def _learn(self, cache: dict, wanted: set[str], lead: str) -> None:
        missing = [w for w in wanted if w not in cache]
        if len(cache) + len(missing) > MOST_KEPT:
            cache.clear()
            missing = list(wanted)
        if not missing:
            return
        if not self.with_offsets:
            for w in missing:
                ids = self.ranks.encode_ordinary(lead + w) if self.ranks and not any(x in w for x in self.special) else self.tokenizer.encode(lead + w, add_special_tokens=False).ids
                cache[w] = array("I", ids).tobytes()
            return
        got = self.tokenizer.encode_batch([lead + w for w in missing], add_special_tokens=False)
        cache.update((w, (np.array(e.offsets, np.int64).reshape(-1, 2), len(lead) + len(w))) for w, e in zip(missing, got))

    def prepare(self, texts: list[str]) -> list[list[str]]:
        parts = [self.cut(t) for t in texts]
        self._learn(self.first, {p[0] for p in parts}, "")
        self._learn(self.led, set(chain.from_iterable(p[1:] for p in parts)), " ")
        return parts

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        led = self.led
        parts = self.prepare(texts)
        return [self.first[p[0]] + b"".join([led[w] for w in p[1:]]) for p in parts]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """Character spans of each text's tokens, in order: an ``n x 2`` array. A token of part of a character spans it all.

        With a rank table the ids alone give them: every token stands for known bytes, and the bytes of a text are all its
        tokens' bytes in order. Other tokenizers report offsets for each stretch, which are shifted to its place."""
        out = []
        if self.ranks is not None:
            for text, ids in zip(texts, self.ids(texts)):
                ends = np.cumsum(self.n_bytes[np.frombuffer(ids, "<u4")])
                if not text.isascii():
                    at = np.cumsum(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0 != 0x80)
                    begins = at[np.concatenate([[0], ends[:-1]])] - 1 if len(ends) else ends
                    out.append(np.stack([begins, at[ends - 1] if len(ends) else ends], axis=1))
                else:
                    out.append(np.stack([np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends], axis=1))
            return out
        for p in self.prepare(texts):
            found = [self.first[p[0]]] + [self.led[w] for w in p[1:]]
            lengths = np.array([x[1] for x in found])
            begin = np.cumsum(lengths) - lengths
            out.append(np.concatenate([x[0] for x in found]) + np.repeat(begin, [len(x[0]) for x in found])[:, None])
        return out


@lru_cache(maxsize=2)
def stretches(path: str, spans: bool = False) -> Stretches:
    """One for each Python worker."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Stretches(path, spans)
