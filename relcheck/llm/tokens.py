"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

#: Chunks whose ids a worker remembers; beyond it starts afresh.
REMEMBERED = 600_000


class Merges:
    """Byte-pair merges of many words at once.

    A word is a row of symbols, at first its bytes. As long as a row has a pair
    that merges, its pair of the lowest rank, the leftmost of equals, becomes one
    symbol; that is the order in which the library merges too.
    """

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        self._inner = np.array([vocab[char[b]] for b in range(256)], dtype=np.int64)
        self._final = np.array([vocab[char[b] + suffix] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        code = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.int64)
        self._made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._none = len(pairs)
        self._code, self._rank = np.full(1 << 18, -1, dtype=np.int64), np.full(1 << 18, self._none, dtype=np.int64)
        for rank, (slot, value) in enumerate(zip(self._slot(code).tolist(), code.tolist(), strict=True)):
            while self._code[slot] >= 0:
                slot = (slot + 1) % len(self._code)
            self._code[slot], self._rank[slot] = value, rank

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * 0x9E3779B1 >> 7) & 0x3FFFF

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, `_none` for those that don't merge; symbols under 0 are no symbols."""
        code = np.where((a >= 0) & (b >= 0), a << 16 | b, -2)
        slot = self._slot(code)
        out = np.full(code.shape, self._none, dtype=np.int64)
        at = np.arange(code.size)
        code, slot, flat = code.ravel(), slot.ravel(), out.ravel()
        while len(at):
            found = self._code[slot]
            hit = found == code
            flat[at[hit]] = self._rank[slot[hit]]
            more = (found >= 0) & ~hit
            at, code, slot = at[more], code[more], (slot[more] + 1) & 0x3FFFF
        return flat.reshape(out.shape)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and their numbers; words have a byte at least."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        rows = np.full((len(words), width + 1), -1, dtype=np.int64)
        inside = np.arange(width + 1) < size[:, None]
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        rows[inside] = self._inner[data]
        rows[np.arange(len(words)), size - 1] = self._final[data[np.cumsum(size) - 1]]
        ranks = np.concatenate((self._ranks(rows[:, :-1], rows[:, 1:]), np.full((len(words), 1), self._none)), axis=1)
        done = np.full((len(words), width + 1), -1, dtype=np.int64)
        live, columns = np.arange(len(words)), np.arange(width + 1)
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            over = best == self._none
            if over.any():
                done[live[over], : rows.shape[1]] = rows[over]
                live, rows, ranks, at, best = live[~over], rows[~over], ranks[~over], at[~over], best[~over]
                if not len(live):
                    break
            n = np.arange(len(live))
            rows[n, at] = self._made[best]
            keep = columns[: rows.shape[1]] != (at + 1)[:, None]
            rows, ranks = rows[keep].reshape(len(live), -1), ranks[keep].reshape(len(live), -1)
            ends = rows.shape[1] - 1
            after = np.minimum(at + 1, ends)
            ranks[n, at] = np.where(at < ends, self._ranks(rows[n, at], rows[n, after]), self._none)
            left = np.maximum(at - 1, 0)
            ranks[n, left] = np.where(at > 0, self._ranks(rows[n, left], rows[n, at]), ranks[n, left])
        flat, count = done[done >= 0], (done >= 0).sum(1)
        return flat, count


def _plain(core: bytes) -> bool:
    """Whether normalising would leave this a word of letters, as it is."""
    word = core.decode("utf-8", "replace")
    return word.isalpha() and word.lower() == word and unicodedata.is_normalized("NFC", word)


class Encoder:
    """Ids of texts under a `tokenizers` file.

    special: a special token's string in a text is that token, as the library has it
    by default; otherwise it is ordinary text, and no text has a special token's id.

    separable: the tokenizer lowers case, drops white space, never joins what white
    space or a change from letters to other signs separates, and marks the last
    token of each word. Then each distinct chunk between ASCII white space is
    encoded once and its ids are reused, with the same result as for whole texts.
    """

    def __init__(self, path: str, separable: bool, dtype: str = "<u4", special: bool = False):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # Separable texts are cut at special tokens before they are lowered, which may make more such strings.
        self._tokenizer.encode_special_tokens = separable or not special
        added = self._tokenizer.get_added_tokens_decoder().items() if special and separable else ()
        self._added = {token.content.encode(): np.array([i], dtype=dtype).tobytes() for i, token in added}
        # The longest of those that begin at a place, as in the library.
        self._cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + b")") if self._added else None
        self._separable, self._dtype, self._known = separable, dtype, {}
        if separable:
            with open(path, encoding="utf-8") as file:
                model = json.load(file)["model"]
            self._merges = Merges(model)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(self._tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=self._dtype).tobytes() for t in texts]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Lower-case words of letters only, in batches of like lengths."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: list[bytes] = [b""] * len(words)
        width = np.dtype(self._dtype).itemsize
        for i in range(0, len(order), 4096):
            some = order[i : i + 4096]
            ids, count = self._merges.encode([words[j] for j in some])
            data, end = ids.astype(self._dtype).tobytes(), 0
            for j, n in zip(some, (count * width).tolist(), strict=True):
                out[j] = data[end : end + n]
                end += n
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        """Chunks that are a word of letters, with or without one point or comma, are taken apart."""
        known, words, joined, odd = self._known, set(), [], []
        for chunk in chunks:
            core = chunk[:-1] if chunk[-1] in b".," else chunk
            if len(core) > 64 or not (core.isalpha() or _plain(core)):
                odd.append(chunk)
                continue
            if core is not chunk:
                joined.append((chunk, core))
            if core not in known:
                words.add(core)
        words = list(words)
        known.update(zip(odd, self._encode(odd), strict=True))
        known.update(zip(words, self._encode_words(words), strict=True))
        for sign in (b".", b","):
            if sign not in known:
                known[sign] = self._encode([sign])[0]
        for chunk, core in joined:
            known[chunk] = known[core] + known[chunk[-1:]]

    def _ids_between(self, texts: list[bytes]) -> list[bytes]:
        """The same for texts with special tokens, which are matched before all else."""
        parts = [self._cut.split(t) for t in texts]
        found = iter(self.ids([x for p in parts for x in p[::2]]))
        return [b"".join(next(found) if i % 2 == 0 else self._added[x] for i, x in enumerate(p)) for p in parts]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if not self._separable:
            return self._encode(texts)
        if self._cut and any(map(self._cut.search, texts)):
            return self._ids_between(texts)
        known, out, late, fresh = self._known, [], [], set()
        for i, text in enumerate(texts):
            chunks = text.lower().split()
            try:
                out.append(b"".join(map(known.__getitem__, chunks)))
            except KeyError:
                out.append(b"")
                late.append((i, chunks))
                fresh.update(set(chunks).difference(known))
        if late:
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = set().union(*(chunks for _, chunks in late))
            self._learn(list(fresh))
            for i, chunks in late:
                out[i] = b"".join(map(known.__getitem__, chunks))
        return out


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
