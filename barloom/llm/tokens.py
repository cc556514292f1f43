"""Token ids of a word-level BPE vocabulary, by a cache of white-space separated chunks."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Chunks a cache holds before it starts anew, and the longest chunk that it keeps: about 80 MB at worst.
CACHE_CHUNKS = 400_000
CACHE_CHARS = 40
#: The marker of a word's end inside the byte BPE: a byte that UTF-8 never has.
WORD_END = b"\xff"
#: Marks that often follow a word; a chunk is then its word's ids and the marks' ids. No apostrophe: 's and the like are pieces.
MARKS = ".,;:!?#$%&*|\"-()"
#: The characters that str.split takes as white space but the vocabulary's \s does not.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Chunks(dict):
    """chunk -> its ids as little-endian 16-bit bytes; unknown chunks are encoded when they are asked for."""

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.full = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        printable = self._byte_of_char()

        def raw(token: str) -> bytes:
            end = token.endswith(suffix) and len(token) > len(suffix)
            body = token[: -len(suffix)] if end else token
            return bytes(printable[c] for c in body) + WORD_END * end

        ids = {raw(t): i for t, i in vocab.items() if t not in self.specials}
        # the end of a word joins its last byte before anything else: those tokens get the lowest ranks of all pairs
        order = {b: 512 + n for n, b in enumerate(raw("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"])}
        first = [b for b in ids if b not in order]
        ranks = {b: n for n, b in enumerate(sorted((b for b in first if len(b) == 1)))}
        ranks |= {b: 256 + n for n, b in enumerate(sorted(b for b in first if len(b) == 2))}
        ranks |= order
        self.id_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.id_of[r] = ids[b].to_bytes(2, "little")
        self.pieces = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @staticmethod
    def _byte_of_char() -> dict[str, int]:
        """Byte-level BPE writes bytes that don't print as characters from 256 on."""
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in prints]
        return {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(others)}

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) < "ɐ":
            if chunk.isalpha():
                words = [chunk]
            elif (word := chunk.rstrip(MARKS)).isalpha():
                found = self[word] + self[chunk[len(word) :]]
                if len(chunk) <= CACHE_CHARS and len(self) < CACHE_CHUNKS:
                    self[chunk] = found
                return found
            else:
                words = self.pattern.findall(chunk)
            pieces, id_of = self.pieces, self.id_of
            found = b"".join([id_of[i] for w in words for i in pieces(w.encode() + WORD_END)])
        else:
            found = np.array(self.full.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = found
        return found

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text as 16-bit numbers; null and blank texts have none."""
        if not text:
            return np.zeros(0, "<u2")
        if not text.isascii():
            if any(s in text for s in self.specials) or any(c in text for c in ODD_SPACES):
                return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u2")
            whole = text
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
            if not unicodedata.is_normalized("NFC", text):  # a chunk that is encoded alone would be normalised again
                return np.array(self.full.encode(whole, add_special_tokens=False).ids, "<u2")
        else:
            if "<|" in text and any(s in text for s in self.specials) or any(c in text for c in ODD_SPACES):
                return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u2")
            text = text.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u2")


@functools.lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    """One a Python worker and vocabulary."""
    return Chunks(path)


def forget(path: str) -> None:
    """Empty the cache of a vocabulary; at the end of a task, since its worker stays with what it holds."""
    chunks(path).clear()
