"""Tokenizers by path: the library that a file is for, or an equal, faster encoder where one exists.

Byte-pair files of two common forms are handed to the rank-based encoder of tiktoken: merging
the adjacent pair of lowest rank gives the same pieces as applying the file's merges in order.
Texts that the simpler splitting does not cover go to the file's own library whole.
"""

from __future__ import annotations

import array
import json
import os
import re

#: Characters whose classes, lower case and normal form do not differ between the libraries' tables;
#: no two of them compose. Texts with any other go to the file's own library whole.
_VERIFIED = (
    "\x01-\x7f\xa0-\u012f\u0131-\u017e\u0400-\u0481\u048a-\u052f\u2010-\u2027\u2030-\u205e\u20ac\u2122"
    "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f5ff\U0001f600-\U0001f64f"
)
_OTHER = re.compile(f"[^{_VERIFIED}]")
_ODD_BLANK = re.compile(r"[^\S \n]|[ \n][ \n]|^\s|\s$")
_SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"

#: To be raised with every change that may change ids or counts; stored counts carry it.
REVISION = 2

_loaded: dict[str, Tokenizer] = {}
_plain: dict[str, Library] = {}


def load(path: str) -> Tokenizer:
    """The tokenizer of this Python worker for the path."""
    if path not in _loaded:
        made: Tokenizer
        if path.endswith(".model"):
            made = PieceModel(path)
        else:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            made = next((k(path, spec) for k in (ByteRanks, WordRanks) if k.fits(spec)), None) or Library(path, spec)
        _loaded[path] = made
    return _loaded[path]


def load_plain(path: str) -> Library:
    """As load, of a tokenizers file; strings of special tokens in a text are plain text."""
    if path not in _plain:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = next((k for k in (ByteRanks,) if k.fits(spec)), Library)
        made = kind(path, spec)
        made.library.encode_special_tokens = True
        made.added = [t["content"] for t in spec.get("added_tokens", []) if not t.get("special")]
        _plain[path] = made
    return _plain[path]


def blanks_do_not_count(path: str) -> bool:
    """Whether the file's tokenizer only ends words at ASCII white space, whatever its kind and amount."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return WordRanks.fits(spec) and not any(t["content"].split() != [t["content"]] for t in spec.get("added_tokens", []))


class Tokenizer:
    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as native unsigned 32-bit numbers."""
        raise NotImplementedError

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.ids(texts)]


class PieceModel(Tokenizer):
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", x).tobytes() for x in self.model.encode(texts, num_threads=1)]


class Library(Tokenizer):
    """The tokenizers library, without added special tokens, padding or truncation."""

    def __init__(self, path: str, spec: dict) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.added = [t["content"] for t in spec.get("added_tokens", [])]

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array.array("I", x.ids).tobytes() for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def ids_after_space(self, texts: list[str]) -> list[bytes]:
        """As ids, of a space and each text."""
        return self.ids([" " + t for t in texts])

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id of a byte-level vocabulary stands for; b"" for ids that it lacks."""
        letters = _byte_letters()
        out = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return out

    def has_added(self, text: str) -> bool:
        return any(a in text for a in self.added)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for
    themselves, the others in order from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merged(spec: dict) -> list[str]:
    return ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in spec["model"]["merges"]]


class ByteRanks(Library):
    """Byte-level pairs without a normaliser, split by the usual pattern; ids follow the merges."""

    @staticmethod
    def fits(spec: dict) -> bool:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            return False
        if any(model.get(k) for k in ("unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        ids = [model["vocab"][m] for m in _merged(spec)]
        return ids == sorted(set(ids)) and set(_byte_letters()) <= model["vocab"].keys()

    def __init__(self, path: str, spec: dict) -> None:
        import tiktoken

        super().__init__(path, spec)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        ranks = {bytes(letters[c] for c in t): vocab[t] for t in [*letters, *_merged(spec)]}
        self.encoder = tiktoken.Encoding("byte-ranks", pat_str=_SPLITS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[bytes]:
        return self._encoded(texts, texts)

    def ids_after_space(self, texts: list[str]) -> list[bytes]:
        # a space before a text that starts with none goes to its first word
        return self._encoded([" " + t for t in texts], texts)

    def _encoded(self, texts: list[str], looked_at: list[str]) -> list[bytes]:
        # with single blanks only, the pattern's look-ahead for runs of white space never matters
        plain = [not (_ODD_BLANK.search(t) or _OTHER.search(t) or self.has_added(t)) for t in looked_at]
        rest = iter(super().ids([t for t, p in zip(texts, plain, strict=True) if not p])) if not all(plain) else iter(())
        encode = self.encoder.encode_ordinary
        return [array.array("I", encode(t)).tobytes() if p else next(rest) for t, p in zip(texts, plain, strict=True)]


class WordRanks(Library):
    """Lower-cased words with an end mark, white space dropped. Ids are the library's; counts are faster.

    A NUL after each word stands for the end mark. It merges with the last byte first, so the
    pairs are those of a vocabulary whose last letters carry the mark.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    @classmethod
    def fits(cls, spec: dict) -> bool:
        model, norm, pre = spec["model"], spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = pre[0]
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            return False
        steps = [x["type"] for x in norm.get("normalizers", [])]
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        return (
            plain
            and model.get("end_of_word_suffix") == "</w>"
            and steps == ["NFC", "Replace", "Lowercase"]
            and norm["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
            and norm["normalizers"][1].get("content") == " "
            and split.get("type") == "Split"
            and split.get("pattern") == {"Regex": cls.PATTERN}
            and split.get("behavior") == "Removed"
            and split.get("invert") is True
            and [p["type"] for p in pre[1:]] == ["ByteLevel"]
            and not pre[1].get("use_regex", True)
            and not pre[1].get("add_prefix_space")
        )

    def __init__(self, path: str, spec: dict) -> None:
        import regex
        import tiktoken

        super().__init__(path, spec)
        letters = _byte_letters()
        words = [bytes([b]) for b in range(256)] + [bytes([b, 0]) for b in range(1, 256)]
        words += [bytes(letters[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>") for t in _merged(spec)]
        self.encoder = tiktoken.Encoding("word-ranks", pat_str=r"[^\x00]*\x00", mergeable_ranks={w: i for i, w in enumerate(words)}, special_tokens={})
        self.words = regex.compile(self.PATTERN).findall

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int | None] = []
        rest = []
        for t in texts:
            if _OTHER.search(t) or self.has_added(t):
                out.append(None)
                rest.append(t)
                continue
            words = self.words(t.lower())
            out.append(len(self.encoder.encode_ordinary("\0".join(words) + "\0")) if words else 0)
        whole = iter(super().counts(rest)) if rest else iter(())
        return [next(whole) if n is None else n for n in out]
