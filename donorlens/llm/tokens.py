"""Token ids of whole texts with a public BPE vocabulary that works word by word.

``word_bpe_49k`` lower-cases, cuts a text into pre-tokens (runs of letters, single
digits, runs of other signs) and merges within each pre-token, so a text's ids
are its pre-tokens' ids, one after the other. Each worker keeps the ids of the
pre-tokens it has met (at most ``2 * CACHE_ENTRIES``); new ones are merged by the
vocabulary's BPE model, all those of a slice of texts in one call. Words with
other than printable ASCII and Latin letters go through the whole tokenizer.
"""

from __future__ import annotations

import re

import numpy as np

CACHE_ENTRIES = 400_000
_CHUNK = 64
_ODD = b"\0"  # marks a cache key that is a whole word, as it stands

# printable ASCII, ASCII white space, and UTF-8 bytes of U+00C0 to U+024F
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
# among those: not letters (multiplication and division sign), a letter that grows when
# lower-cased, and the start of the vocabulary's special tokens
_NOT_PLAIN = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"<|")
# the vocabulary file's pre-token pattern (fixed value), for plain lower-case text in UTF-8
_PRETOKEN = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff\s]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _is_plain(data: bytes) -> bool:
    return not data.translate(None, _PLAIN) and not any(x in data for x in _NOT_PLAIN)


def _lower(data: bytes) -> bytes:
    return data.lower() if data.isascii() else data.decode().lower().encode()


def pretokens(data: bytes) -> list[bytes]:
    """Cache keys of a text: pre-tokens, and marked words that only the whole tokenizer can cut."""
    if _is_plain(data):
        return _PRETOKEN.findall(_lower(data))
    out = []
    for word in data.split():
        if _is_plain(word):
            out += _PRETOKEN.findall(_lower(word))
        else:
            out.append(_ODD + word)
    return out


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit integers, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.merge = Tokenizer(self.full.model)
        self.merge.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.full.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.young: dict = {}
        self.old: dict = {}
        # byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(256 + k) for k, b in enumerate(others) if b != 32}

    def _learn(self, new: list[bytes]) -> None:
        odd = [w for w in new if w[:1] == _ODD]
        for w in odd:
            self.young[w] = np.array(self.full.encode(w[1:].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        pre = [w for w in new if w[:1] != _ODD] if odd else new
        chunks = [b" ".join(pre[i:i + _CHUNK]).decode("latin-1").translate(self.letters)
                  for i in range(0, len(pre), _CHUNK)]
        found = self.merge.encode_batch_fast(chunks, add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(stops) != len(pre):
            raise ValueError("the vocabulary does not end every pre-token with an end-of-word token")
        raw, at = ids.tobytes(), 0
        for p, stop in zip(pre, (stops * 4).tolist()):
            self.young[p] = raw[at:stop]
            at = stop

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        cut = [pretokens(t) if t else [] for t in texts]
        young, old = self.young, self.old
        new = [p for p in set().union(*cut) if p not in young]
        if old:
            young |= {p: old[p] for p in new if p in old}
            new = [p for p in new if p not in young]
        if new:
            self._learn(new)
        out = [b"".join([young[p] for p in ps]) for ps in cut]
        if len(young) > CACHE_ENTRIES:
            self.old, self.young = young, {}
        return out


def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_word_tokenizers", {})
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def batches(texts: list, most: int = 2_000_000):
    """Slices of ``texts`` of about ``most`` bytes, so one slice's words stay few."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) if t else 0
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
