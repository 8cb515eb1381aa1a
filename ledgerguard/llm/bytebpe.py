"""Byte-level BPE of whole texts by tiktoken, equal to the tokenizers library on the tokenizer's own ``.json`` file.

tiktoken joins any two neighbours that form a known token, the library only the pairs that its file lists. Both
come to the same if each token, encoded by itself, is one token (then the two neighbours that form it can only
be the listed pair); ``fast`` checks this for the whole vocabulary, along with the pattern, the bytes and the
order of merges. What tiktoken could read differently goes to the library: characters whose class differs between
versions of Unicode, special strings, and very long stretches without white space.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# characters whose class has been the same in all versions of Unicode of the last twenty years
_SETTLED = (r"\x00-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞₠-€"
            r"、-〃ぁ-ゔァ-ヺ一-龥가-힣！-～")
LONGEST = 1000  # characters without white space that tiktoken gets


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def one_token_each(vocab: dict[str, int], merges: list[tuple[str, str]], names: list[str], **options) -> bool:
    """Whether each of ``names``, encoded by itself, is one token: then no two neighbours but the listed pair form it."""
    from tokenizers import Tokenizer, models
    alone = Tokenizer(models.BPE(vocab=vocab, merges=merges, **options))
    return all(e.ids == [vocab[n]] for n, e in zip(names, alone.encode_batch_fast(names, add_special_tokens=False)))


def merges_of(model: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


class LatinWords:
    """Ids of lower-case words of Latin letters under a byte-level BPE with word ends (``</w>``), many words in one
    call of tiktoken. Each symbol, a byte inside or at the end of a word, is given a character of its own."""

    END = "</w>"
    LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"

    def __init__(self, config: dict) -> None:
        self.encoding = None
        model = config["model"]
        vocab, merges = model["vocab"], merges_of(model)
        used = sorted({b for c in self.LETTERS for b in c.encode()})
        names = {b: c for c, b in byte_alphabet().items()}
        free = [c for c in range(1, 128) if c != 10]
        self.inner, self.last = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
        self.inner[10] = self.last[10] = 10
        symbols = {}
        for b in used:
            self.inner[b], self.last[b] = free.pop(), free.pop()
            symbols[names[b]], symbols[names[b] + self.END] = int(self.inner[b]), int(self.last[b])
        ranks, tokens = {}, []
        for token, i in vocab.items():
            head, end = (token[:-len(self.END)], True) if token.endswith(self.END) else (token, False)
            if head and all(c in symbols for c in head):
                ranks[bytes([symbols[c] for c in head[:-1]] + [symbols[head[-1] + (self.END if end else "")]])] = i
                tokens.append(token)
        order = [vocab.get(a + b, -1) for a, b in merges]
        usual = (model.get("end_of_word_suffix") == self.END and not model.get("dropout") and not model.get("ignore_merges")
                 and all(x < y for x, y in zip(order, order[1:])) and all(s in vocab for s in symbols))
        self.gap = max(vocab.values()) + 1  # the id of the break
        if usual and self._formed(merges, vocab, set(tokens), set(symbols)):
            import tiktoken
            ranks[b"\n"] = self.gap
            self.encoding = tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})

    def _formed(self, merges: list, vocab: dict, tokens: set, symbols: set) -> bool:
        """Whether each token that is no symbol comes out of its own symbols as one token."""
        listed = {(a, b): vocab[a + b] for a, b in merges if a + b in tokens}
        for token in tokens - symbols:
            head = token.removesuffix(self.END)
            parts = [*head[:-1], head[-1] + token[len(head):]]
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: listed.get((parts[i], parts[i + 1]), self.gap))
                if (parts[best], parts[best + 1]) not in listed:
                    return False
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return True

    def encode(self, words: list[str]) -> np.ndarray:
        """Ids of words that are not empty, with ``gap`` between words."""
        raw = np.frombuffer("\n".join(words).encode(), np.uint8)
        out = self.inner[raw]
        ends = np.append(np.flatnonzero(raw == 10), len(raw)) - 1
        out[ends] = self.last[raw[ends]]
        return np.frombuffer(self.encoding._core_bpe.encode_to_tiktoken_buffer(out.tobytes().decode("ascii"), set()), "<u4")


class ByteBpe:
    """Ids of texts. ``plain``: special strings inside texts are ordinary text, else they are their own ids."""

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            self.config = json.load(f)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        specials = [] if plain else [t["content"] for t in self.config.get("added_tokens", [])]
        # (one search for each: a joint pattern takes twice as long)
        self._strange = [re.compile(p).search for p in (f"[^{_SETTLED}]", r"(?<!\S)\S{%d}" % LONGEST, *map(re.escape, specials))]
        self.fast = self._fast()

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; of ids outside the model's vocabulary, their content."""
        alphabet, out = byte_alphabet(), [b""] * self.library.get_vocab_size()
        for t in self.config.get("added_tokens", []):
            out[t["id"]] = t["content"].encode()
        for token, i in self.config["model"]["vocab"].items():
            if all(c in alphabet for c in token):
                out[i] = bytes(alphabet[c] for c in token)
        return out

    def _fast(self):
        """tiktoken's encoder, or None where it is not known to give the library's ids."""
        pre, model = self.config.get("pre_tokenizer") or {}, self.config["model"]
        usual = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and self.config.get("normalizer") is None
                 and model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
                 and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix"))
        if not usual:
            return None
        alphabet, vocab = byte_alphabet(), model["vocab"]
        merges = merges_of(model)
        added = {t["content"] for t in self.config.get("added_tokens", [])}
        words = {w: i for w, i in vocab.items() if w not in added}
        ordered = len(words) == 256 + len(merges) and all(words.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        if not ordered or {words.get(c) for c in alphabet} != set(range(256)):
            return None
        if not one_token_each(vocab, merges, list(words)):
            return None
        import tiktoken
        ranks = {bytes(alphabet[c] for c in w): i for w, i in words.items()}
        return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        if self.fast is not None:
            quick = self.fast._core_bpe.encode_to_tiktoken_buffer
            for i, text in enumerate(texts):
                if not any([search(text) for search in self._strange]):
                    out[i] = np.frombuffer(quick(text, set()), "<u4").astype(self.dtype)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.dtype)
        return out
