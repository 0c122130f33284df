"""BPE encoding and decoding by per-prefix dynamic programming.

For each prefix of a word exactly one token can be the last one of the prefix's encoding.
An automaton over the vocabulary lists the tokens that end at a position; the one among
them that is compatible with the last token of the shorter prefix is stored, and following
the stored tokens back from the end of the word emits the ids. Two tokens are compatible
if merging their joined symbols by the merge ranks gives just these two tokens again.

Words repeat, so each Python worker keeps the results of recent words (bounded).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kestrel.llm.common import map_arrow, texts_of

#: Moves a symbol that ends a word out of the way of the same symbol within a word.
END = 0x10000
#: Words that a worker keeps at most: as many again stay from before, so frequent words are not lost.
CACHE = 150_000
#: The vocabulary's word pattern, and its equals for texts of ASCII characters and letters and for
#: texts whose other characters are replaced by the KINDS of a letter, number, space or other one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
QUICK = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
BY_KIND = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Zé]+|[0-9²]|[^\t-\r a-zA-Zé0-9²]+"
KINDS = LETTER, NUMBER, SPACE, OTHER = "é² ¡"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself
    if printable in Latin-1, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixEncoder:
    """Encoder for a tokenizers file of the kind BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self.ids = {self.symbols(t): i for t, i in model["vocab"].items()}
        self.text = {i: s for s, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(self.symbols(a), self.symbols(b)): r for r, (a, b) in enumerate(pairs)}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.whole: dict[str, bool] = {}
        self.bytes = byte_symbols()
        # The library's own Unicode tables say how a character is normalized and what it is.
        library = Tokenizer.from_str(json.dumps({**spec, "model": {**model, "vocab": {}, "merges": []}}))
        self.normalizer, self.pretokenizer = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        if PATTERN not in (p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"]["pretokenizers"]):
            raise ValueError(f"{path}: not the word pattern that is known here")
        self.quick, self.by_kind, self.kinds = re.compile(QUICK).findall, re.compile(BY_KIND).finditer, _Kinds(self.pretokenizer)
        self.plain = {chr(c) for c in range(128)}
        self.letters = {chr(c) for c in range(128) if not 28 <= c < 32}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.encoded = _Cache(self._word_ids)

    def symbols(self, token: str) -> str:
        if token.endswith(self.suffix) and token != self.suffix:
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + END)
        return token

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined symbols of the two tokens merge into these two tokens."""
        a, b = self.text[left], self.text[right]
        if len(self.fits) > CACHE:
            self.fits.clear()
        fit = self.fits[left << 20 | right] = self.merged(a + b) == [a, b]
        return fit

    def merged(self, s: str) -> list[str]:
        """The symbols of a short string, merged pair by pair in the order of the ranks."""
        parts = list(s)
        while len(parts) > 1:
            best, at = min((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def word(self, word: str) -> list[int]:
        """Ids of one word (a string that the vocabulary's pattern matches)."""
        s = "".join(map(self.bytes.__getitem__, word.encode("utf-8")))
        s = s[:-1] + chr(ord(s[-1]) + END)
        if s in self.ids and self._whole(s):
            return [self.ids[s]]
        # The last token of each prefix, and where it starts.
        last, starts, fits = [-1] * (len(s) + 1), [0] * (len(s) + 1), self.fits.get
        for end, (length, token) in self.automaton.iter(s):
            if last[end + 1] < 0:
                start = end + 1 - length
                if start == 0:
                    fit = length == 1 or self._whole(self.text[token])
                else:
                    fit = fits(last[start] << 20 | token)
                    if fit is None:
                        fit = self.compatible(last[start], token)
                if fit:
                    last[end + 1], starts[end + 1] = token, start
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at = starts[at]
        return out[::-1]

    def _whole(self, s: str) -> bool:
        """Whether the token's own symbols merge into the token."""
        known = self.whole.get(s)
        if known is None:
            known = self.whole[s] = len(self.merged(s)) == 1
        return known

    def _word_ids(self, word: str) -> bytes:
        return np.array(self.word(word), "<u4").tobytes()

    def pretokens(self, text: str) -> list[str]:
        """The pattern's matches, on the text itself if it has no characters but ASCII and letters that
        the built-in engine knows, else on the kinds of its characters."""
        for c in set(text) - self.letters:
            if self.kinds[ord(c)] != LETTER or not c.isalpha():
                return [text[m.start() : m.end()] for m in self.by_kind(text.translate(self.kinds))]
            self.letters.add(c)
        return self.quick(text)

    def normalize(self, text: str) -> str:
        """The text as the library normalizes it.

        Python's tables are newer, but agree on texts of old characters (NFC is stable for them)
        that it changes one by one as the library does; all other texts go to the library.
        """
        if text.isascii():
            return text.lower()
        for c in set(text) - self.plain:
            if unicodedata.ucd_3_2_0.category(c) == "Cn" or self.normalizer(c) not in (_normalized(c), " " if c.isspace() else None):
                return self.normalizer(text)
            self.plain.add(c)
        return _normalized(text)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and their decoded text."""
        parts = []
        for k, piece in enumerate(self.split(text)):
            if k % 2:
                parts.append(np.array([self.special[piece]], "<u4").tobytes())
            else:
                parts += map(self.encoded.__getitem__, self.pretokens(self.normalize(piece)))
        ids = b"".join(parts)
        return ids, self.decode(ids)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _normalized(text: str) -> str:
    # Lower case goes character by character: a final sigma is no special case.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class _Kinds(dict):
    """For str.translate: ASCII characters stay, others become their kind, as the library splits."""

    def __init__(self, split):
        self.pieces = split

    def __missing__(self, code):
        ends = [end for _, (_, end) in self.pieces(f"a{chr(code)}.")]
        kind = {(2, 3): LETTER, (1, 2, 3): NUMBER, (1, 3): OTHER}[tuple(ends)]
        if kind == OTHER and len(self.pieces(chr(code))) == 0:
            kind = SPACE
        self[code] = chr(code) if code < 128 else kind
        return self[code]


class _Cache(dict):
    """Recent results in two generations: when the younger is full, it becomes the older."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        if len(key) < 64:
            self[key] = value
        return value


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


#: The columns that encoded() can make, their types, and how they follow from ids and text.
OUTPUTS = {
    "n_tokens": ("long", lambda ids, out: len(ids) // 4),
    "ids": ("binary", lambda ids, out: ids),
    "decoded": ("string", lambda ids, out: out),
    "ids_sha256": ("string", lambda ids, out: hashlib.sha256(ids).hexdigest()),
    "decoded_sha256": ("string", lambda ids, out: hashlib.sha256(out.encode("utf-8")).hexdigest()),
}


def encoded(df: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """df's columns `keep` with the outputs for each row's whole text: n_tokens, ids (binary,
    little-endian unsigned 32-bit), the decoded text, and lowercase SHA-256 of either.

    Null and empty texts have no tokens and decode to the empty text; repeated rows stay
    repeated; other columns of df are ignored, whatever their names.
    """
    rows = df.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)], F.col(text_col).alias("t"))
    types = dict(rows.dtypes)

    def run(batch):
        made = encoder(vocabulary)
        results = [made.encode(t) for t in texts_of(batch, "t")]
        kept = {f"k{n}": batch.column(f"k{n}") for n in range(len(keep))}
        return kept | {name: [OUTPUTS[name][1](*r) for r in results] for name in outputs}

    schema = [f"k{n} {types[f'k{n}']}" for n in range(len(keep))] + [f"{name} {OUTPUTS[name][0]}" for name in outputs]
    return map_arrow(rows, run, ", ".join(schema)).withColumnsRenamed({f"k{n}": c for n, c in enumerate(keep)})
