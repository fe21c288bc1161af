"""BPE encoding by a bounded-lookahead streaming transducer, and decoding by a byte-to-text state machine.

The encoder reads a text in chunks, cuts it into words, and feeds each word's symbols to a transducer that holds back
only what later symbols could still change. A cut is stable when every tokenisation that the unseen rest of the word
can lead to makes it: if a token starts at ``b`` and reaches into the unseen part, what stands before ``b`` is the
tokenisation of that prefix, so the tokens common to the prefixes' tokenisations for all possible ``b`` are final.
The merge list bounds how far back a difference can reach (``sufficient_lookahead``), so the buffer is bounded too.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from ._shared import table

#: Symbols that a word may hold before the transducer looks for stable tokens.
WINDOW = 64
#: Characters that are normalised and cut at a time.
CHUNK = 1 << 16
#: Words whose tokens are remembered, of so many characters at most; the memory starts anew when it is full.
MEMO, MEMO_CHARS = 1 << 18, 256
#: Marks after which a letter begins a word, besides white space: chunks of text without spaces may end there.
WIDE_MARKS = frozenset("。，、！？；：」』）")
# Fixed value: the words of byte-level files that don't state a pattern.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = 1 << 60

# Letters and numbers that Unicode gained after version 16, which the tokenizer library's tables lack,
# and capital letters from version 16 on with their small letters, which Python's tables lack.
LATER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
SMALL_LATER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL_LATER |= {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0x16EA0 + i: 0x16EBB + i for i in range(25)}


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def sufficient_lookahead(merges: list[tuple[str, str]], symbols: dict[str, int]) -> int:
    """A bound, in symbols, on how far left of a word's unseen part its tokens can still change.

    A merge can only be undone by an overlapping merge of earlier rank, and that one by an earlier one again, so a
    change reaches back along a chain of overlapping tokens whose ranks fall. For each merge in order of rank, the
    longest such chain that it can begin is its own length and the longest that begins, at an earlier rank, with one
    of its symbols. ``symbols``: the number of symbols of each token.
    """
    reach_from: dict[str, int] = {}
    longest = 1
    for a, b in merges:
        token = a + b
        reach = symbols[token] + max((reach_from.get(s, 1) for s in set(token)), default=1) - 1
        longest = max(longest, reach)
        reach_from[token[0]] = max(reach_from.get(token[0], 1), reach)
    return longest


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class BpeModel:
    """Vocabulary, merges and text rules of a tokenizer file with byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(pairs):
            self.ranks.setdefault(pair, rank)
        self.merged = [a + b for a, b in pairs]
        lengths = {t: self._symbols(t) for t in self.vocab}
        self.longest_token = max(lengths.values())
        self.lookahead = sufficient_lookahead([p for p in pairs if p[0] + p[1] in lengths], lengths)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.byte_level_decoder = bool(spec.get("decoder")) and spec["decoder"]["type"] == "ByteLevel"
        normalizer = spec.get("normalizer")
        self.steps = [n["type"] for n in (normalizer["normalizers"] if normalizer and normalizer["type"] == "Sequence" else [normalizer] if normalizer else [])]
        if unknown := set(self.steps) - {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers that aren't supported: {sorted(unknown)}")
        cutters = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        splits = [p["pattern"]["Regex"] for p in cutters if p["type"] == "Split"]
        byte_level = [BYTE_LEVEL_WORDS for p in cutters if p["type"] == "ByteLevel" and p.get("use_regex") and not p.get("add_prefix_space")]
        if not splits + byte_level:
            raise ValueError("the file states no pattern of words")
        pattern = (splits + byte_level)[0]
        #: Whether words hold white space; else it is dropped.
        self.spaced = not splits
        self.words = regex.compile(pattern)
        # The same classes without the later letters and numbers; those count as other characters.
        dated = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"[^\s\p{L}\p{N}]", "OTHER")
        dated = dated.replace(r"\p{L}", rf"[\p{{L}}--{LATER.pattern}]").replace(r"\p{N}", rf"[\p{{N}}--{LATER.pattern}]")
        self.words_as_dated = regex.compile("(?V1)" + dated.replace("OTHER", rf"(?:[^\s\p{{L}}\p{{N}}]|{LATER.pattern})"))
        self.to_symbols = byte_alphabet()

    @cached_property
    def beginnings(self) -> set[str]:
        """What a token can begin with, itself excluded."""
        plain = (t.removesuffix(self.suffix) for t in self.vocab)
        return {t[:i] for t in plain for i in range(1, len(t))}

    def _symbols(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix and token != self.suffix else len(token)

    def normalise(self, text: str) -> str:
        """White-space replacement is left out: the words' pattern drops white space of any kind."""
        if "NFC" in self.steps and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.steps:
            # Each letter by itself: a capital sigma doesn't depend on its place in the word.
            text = text.replace("Σ", "σ").lower()
            if not _latin(text):
                text = text.translate(SMALL_LATER)
        return text

    def cut(self, text: str) -> list[str]:
        """Words of a normalised text."""
        if _latin(text) or not LATER.search(text):
            return self.words.findall(text)
        return self.words_as_dated.findall(text)

    def merge(self, parts: list[str]) -> list[str]:
        """Merges the earliest rank, leftmost first, until no pair has one."""
        get = self.ranks.get
        ranks = [get(p, NO_RANK) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            i = ranks.index(best)
            parts[i] = self.merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NO_RANK)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NO_RANK)
        return parts


class Transducer:
    """Tokens of one word from its symbols, in order, as soon as they are stable."""

    def __init__(self, model: BpeModel, window: int = WINDOW):
        self.model, self.window = model, max(window, 2 * model.longest_token)
        self.held: list[str] = []
        self.most_held = 0
        self.next_look = self.window

    def feed(self, symbols: str) -> Iterator[str]:
        for start in range(0, len(symbols), self.window):
            self.held.extend(symbols[start : start + self.window])
            self.most_held = max(self.most_held, len(self.held))
            if len(self.held) > self.next_look:
                yield from self._stable()

    def _stable(self) -> Iterator[str]:
        # The last symbol may turn out to end the word and so be another one: it isn't known yet.
        known = self.held[:-1]
        whole = common = self.model.merge(list(known))
        text = "".join(known[-self.model.longest_token :])
        for back in range(1, len(text)):
            # A token that reaches into the unseen part begins with what is known of it.
            if text[-back:] not in self.model.beginnings:
                continue
            other = self.model.merge(list(known[: len(known) - back]))
            n = next((i for i, (x, y) in enumerate(zip(common, other)) if x != y), min(len(common), len(other)))
            common = common[:n]
        n = sum(map(len, common))
        # What lies further back than the merge list's lookahead is final in any case, so the buffer is bounded.
        while n < len(known) - self.model.lookahead:
            common = whole[: len(common) + 1]
            n += len(common[-1])
        self.held = self.held[n:]
        self.next_look = self.window if n else min(2 * self.next_look, self.model.lookahead + 2 * self.window)
        yield from common

    def finish(self) -> list[str]:
        if self.held:
            self.held[-1] += self.model.suffix
        out = self.model.merge(self.held)
        self.held, self.next_look = [], self.window
        return out


class StreamDecoder:
    """Text of a stream of ids. State: whether a token has come before, and the bytes of an unfinished character.

    Files without a decoder join tokens by a space, as their library does; byte-level decoders turn symbols into bytes.
    """

    def __init__(self, model: BpeModel):
        self.model = model
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False
        self.to_byte = {c: b for b, c in model.to_symbols.items()} if model.byte_level_decoder else {}

    def token_bytes(self, token_id: int) -> bytes:
        text = self.model.texts[token_id]
        if not self.model.byte_level_decoder:
            return text.encode() if not self.started else b" " + text.encode()
        if token_id in self.model.special.values():
            return text.encode()
        return bytes(self.to_byte[c] for c in text)

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        for i in ids:
            data = self.token_bytes(i)
            self.started = True
            if text := self.utf8.decode(data):
                yield text

    def finish(self) -> str:
        self.started = False
        return self.utf8.decode(b"", final=True)


class _Memo(dict):
    """What ``make`` gives for a key; it starts anew when it holds MEMO entries, and long keys aren't held."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        out = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[key] = out
        return out


class Codec:
    """Encodes and decodes whole texts piece by piece."""

    def __init__(self, path: str):
        self.model = BpeModel(path)
        self.translate = {b: ord(c) for b, c in self.model.to_symbols.items()}
        self.ids_of = _Memo(lambda word: " ".join(map(str, self.word_ids(word))))
        self.text_of = _Memo(self.piece_text)

    def word_ids(self, word: str) -> list[int]:
        symbols = word if word.isascii() and word.isprintable() and " " not in word else word.encode("utf-8").decode("latin-1").translate(self.translate)
        t = Transducer(self.model)
        vocab = self.model.vocab
        return [vocab[x] for x in (*t.feed(symbols), *t.finish())]

    def piece_text(self, ids: str) -> str:
        d = StreamDecoder(self.model)
        return "".join(d.feed(map(int, ids.split(" ")))) + d.finish()

    def _parts(self, text: str, i: int) -> bool:
        """Whether a word or white space begins at ``i`` whatever comes before and after, and no composed character or
        added token lies across it."""
        if text[i - 1] in WIDE_MARKS and text[i].isalpha():
            return True
        if self.model.spaced:  # a single space belongs to the word after it
            return text[i] in " \n" and not text[i - 1].isspace() and i + 1 < len(text) and not text[i + 1].isspace()
        return text[i] in " \n\t\r"

    def chunks(self, text: str) -> Iterator[str]:
        """The text in chunks of CHUNK characters, or as many more as an unbroken word has."""
        at = 0
        while at < len(text):
            end = at + CHUNK
            if end >= len(text):
                end = len(text)
            else:
                end = next((i for i in range(end, at, -1) if self._parts(text, i)), 0) or next((i for i in range(end + 1, len(text)) if self._parts(text, i)), len(text))
            yield text[at:end]
            at = end

    def _plain(self, text: str) -> list[str]:
        """Ids of a text without added tokens, word by word."""
        return [self.ids_of[w] for w in self.model.cut(self.model.normalise(text))]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Ids of the text, joined by spaces word by word, for one chunk after another."""
        model = self.model
        for chunk in self.chunks(text):
            if model.special_pattern and model.special_pattern.search(chunk):
                out: list[str] = []
                last = 0
                for m in model.special_pattern.finditer(chunk):
                    out += self._plain(chunk[last : m.start()])
                    out.append(str(model.special[m[0]]))
                    last = m.end()
                yield out + self._plain(chunk[last:])
            else:
                yield self._plain(chunk)

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.pieces(text) for piece in part for i in piece.split(" ")]

    def decode(self, ids: Iterable[int]) -> str:
        d = StreamDecoder(self.model)
        return "".join(d.feed(ids)) + d.finish()

    def digests(self, text: str, gather: list[str] | None = None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by spaces, SHA-256 of the text that they decode to. ``gather`` gets
        the ids, joined by spaces, piece by piece."""
        n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
        decoder = StreamDecoder(self.model)
        sep = False
        for part in self.pieces(text):
            if not part:
                continue
            ids = " ".join(part)
            n += ids.count(" ") + 1
            if gather is not None:
                gather.append(ids)
            if sep:
                ids_sha.update(b" ")
            ids_sha.update(ids.encode())
            if self.model.byte_level_decoder:
                # A character may lie across tokens, pieces and chunks: the decoder's state goes on.
                text_sha.update("".join(decoder.feed(map(int, ids.split(" ")))).encode())
            else:
                # Tokens are whole texts joined by spaces, so that those of a piece can be remembered.
                text_sha.update(b" " * sep + " ".join(map(self.text_of.__getitem__, part)).encode())
            sep = True
        text_sha.update(decoder.finish().encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()


def ship(spark: SparkSession, path: str) -> str:
    """Sends the tokenizer file to all executors; the name to find it by there."""
    name = path.rsplit("/", 1)[-1]
    spark.sparkContext.addFile(path)
    return name


_CODECS: dict[str, Codec] = {}


def _codec(name: str) -> Codec:
    """One codec for each Python worker."""
    path = SparkFiles.get(name)
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``token_ids`` (array<int>) of each row's text.

    Whole texts are encoded, special tokens in a text included; decoding starts from the ids. A null text counts as
    empty: no ids, and the digests are those of the empty string. Repeated rows and null keys are rows of their own.
    Other columns aren't read. An empty table gives an empty result. Memory: one Arrow batch, MEMO words, a chunk of a
    text and its longest word.
    """
    name = ship(docs.sparkSession, path)
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in batches:
            texts = batch.column(1)
            rows, all_ids = [], []
            for i in range(len(texts)):
                t = texts[i].as_py() or ""
                gathered: list[str] | None = [] if ids else None
                rows.append(codec.digests(t, gathered))
                if ids:
                    all_ids.append(np.fromstring(" ".join(gathered), np.int32, sep=" "))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {key_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else "")
    return docs.select(key, text).mapInArrow(run, schema)


def op7_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)
