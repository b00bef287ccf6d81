"""Helpers shared by the training-data operators.

* tables written to the folder that the cluster shares (``spark.checkpoint.dir``),
* batch limits, so that a Python worker holds a bounded number of texts,
* dealing rows into consecutive key ranges with their right neighbour,
* a cache of tokenized words in front of a ``tokenizers`` model.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.files import shared_dir

#: Rows and bytes of one Arrow batch: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than the files that it
    had not yet committed.  The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """df, which must have few rows, collected once: it takes no files, and its broadcast no job."""
    return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Limits the rows and bytes that a Python worker gets at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: T.StructType) -> DataFrame:
    """df through fn, batch by batch; a dict from fn becomes a batch of the schema."""
    bounded_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield to_batch(out, arrow) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """Lists or numpy arrays by name as a batch."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def set_aside(df: DataFrame, own: list[str]) -> tuple[DataFrame, list[Column]]:
    """df with all columns but its own under names that no operator uses, and what to select to have them back."""
    other = [c for c in df.columns if c not in own]
    names = {c: f"aside{k}" for k, c in enumerate(other)}
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns]), [F.col(names.get(c, c)).alias(c) for c in df.columns]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def values_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def checked_broadcast(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, to be joined by a shuffle.

    df is counted, so it should be a written table or cheap to make.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def range_of(df: DataFrame, key: str, parts: int) -> tuple[Column, int]:
    """An expression for the number of the key's range, from 0, and how many ranges there are.

    The splits are quantiles of the key alone, so the scan reads one column and
    the driver gets parts - 1 numbers.  Null keys go to range 0.
    """
    splits = []
    if parts > 1:
        probs = [k / parts for k in range(1, parts)]
        found = df.select(F.percentile_approx(key, probs, max(10_000, 20 * parts)).alias("q")).first()["q"]
        splits = sorted({int(x) for x in found or []})
    if not splits:
        return F.lit(0), 1
    edges = F.array(*[F.lit(x).cast("long") for x in splits])
    at = F.expr("0")
    # a binary search over the sorted splits: log2(parts) comparisons a row
    at = F.coalesce(_search(F.col(key), splits, 0, len(splits)), at) if len(splits) < 4096 else F.size(F.filter(edges, lambda e: e <= F.col(key)))
    return at, len(splits) + 1


def _search(key: Column, splits: list[int], low: int, high: int) -> Column:
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key >= splits[mid], _search(key, splits, mid + 1, high)).otherwise(_search(key, splits, low, mid))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: White space by Unicode's property White_Space, as the tokenizers' patterns mean it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts where a pattern of byte-level models that starts tokens with one optional space always cuts too.
SPACED_WORDS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Cuts for models that drop white space.
BARE_WORDS = re.compile(rf"[^{SPACE}]+")


#: White space but for spaces and line ends.
_RARE_SPACE = [chr(k) for k in [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000] if k != 10]


def spaced_words(text: str) -> list[str]:
    """What ``SPACED_WORDS`` finds; by plain splits where white space is spaces and line ends, two in a row at most, one at the end."""
    rare = _RARE_SPACE[:4] if text.isascii() else _RARE_SPACE
    if "\0" not in text and not any(c in text for c in rare):
        flat = text.replace("\n", " ")
        if "   " not in flat and not flat.endswith("  "):
            return list(filter(None, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))
    return SPACED_WORDS.findall(text)


#: Signs (no apostrophe, which may start a token with letters) that end a stretch of letters for the patterns above.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"


#: Kinds of bytes: letters in lower case (those of Latin-1 by their lead and second byte), signs, digits, and the rest, which has unknown neighbours.
_LETTER, _SIGN, _DIGIT, _REST = 1, 2, 4, 8
_KIND = np.full(256, _REST, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[[ord(c) for c in SIGNS]] = _SIGN
_KIND[ord("0") : ord("9") + 1] = _DIGIT
#: By 16 * the kind before + the kind: 1 if a stretch starts, 2 for white space.
_STARTS = np.zeros(256, np.uint8)
_STARTS[[_LETTER, _SIGN, _DIGIT, _REST]] = 1
_STARTS[[16 * a + b for a in (_LETTER, _SIGN, _DIGIT) for b in (_LETTER, _SIGN, _DIGIT) if a != b or a == _DIGIT]] = 1
_STARTS[::16] = 2
#: The same where letters of Latin-1 are the only ones beyond ASCII: a lead byte 0xC3 and a second byte.
_KIND_SECOND = _KIND.copy()
_KIND_SECOND[[0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = _LETTER
#: A pre-tokenizer's pattern whose stretches are told by kinds, as JSON has it.
_PATTERN = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space beyond ASCII, as a pattern.
_FAR_SPACE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Lead bytes from here on may start a mark that joins the character before it.
_MARKS = 0xCC


def _mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table.take(data) for bytes; numpy would make places of eight bytes first."""
    return np.frombuffer(bytearray(data).translate(table.tobytes()), np.uint8)


def _stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The stretches of texts without nulls, in lower case, and how many there are up to each text's start and the end.

    For patterns ``'s|...|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`` a token never
    crosses their edges: white space, and any change between letters, signs (no
    apostrophe) and digits of known kind.  A capital before a mark stays: some
    are one character with it in lower case alone.
    """
    if pc.any(pc.match_substring_regex(texts, _FAR_SPACE)).as_py():
        texts = pc.replace_substring_regex(texts, _FAR_SPACE, " ")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, raw = texts.buffers()
    edges = np.frombuffer(places, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.zeros(int(edges[-1] - edges[0]) + 1, np.uint8)  # a last byte that ends all
    if len(data) > 1:
        data[:-1] = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    free = data[1:] < _MARKS
    free[edges[(edges > 0) & (edges < len(free))] - 1] = True
    capital = (data[:-1] - np.uint8(ord("A")) < 26) & free
    data[:-1] += capital.view(np.uint8) << np.uint8(5)
    kind = _mapped(data, _KIND)
    at = np.flatnonzero(data == 0xC3)
    if len(at):
        second = data[at + 1]
        second += ((second < 0x9F) & (second != 0x97) & free[at + 1]).view(np.uint8) << np.uint8(5)
        data[at + 1] = second
        at = at[(second >= 0x9F) & (second != 0xB7)]
        kind[at] = kind[at + 1] = _LETTER
    kind = kind[:-1]
    start = np.empty(len(kind), np.uint8)
    start[1:] = _mapped((kind[:-1] << np.uint8(4)) | kind[1:], _STARTS)
    first = edges[edges < len(kind)]
    start[first] = _STARTS[kind[first]]
    sizes = [np.count_nonzero(kind[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    here = np.flatnonzero(np.frombuffer(bytearray(start).translate(None, b"\2"), bool))
    kept = bytearray(data[:-1]).translate(None, b"\t\n\v\f\r ")
    found = pa.StringArray.from_buffers(len(here), pa.py_buffer(np.append(here, len(kept)).astype(np.int32)), pa.py_buffer(kept))
    return found, np.searchsorted(here, np.cumsum([0, *sizes]))


#: Kinds of bytes for byte-level patterns: 0 a space, 1 letters, 2 signs, 3 digits, 4 the apostrophe, 5 the rest, which has unknown neighbours, 6 other white space.
_LED = np.full(256, 5, np.uint8)
_LED[32] = 0
_LED[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
_LED[[ord(c) for c in SIGNS + "_"]] = 2
_LED[ord("0") : ord("9") + 1] = 3
_LED[ord("'")] = 4
_LED[[9, 10, 11, 12, 13]] = 6
#: By 8 * the kind before + the kind: 1 if a stretch starts, 2 for white space after white space.
_LED_STARTS = np.zeros(256, np.uint8)
_LED_STARTS[[8 * a + b for a in range(6) for b in (0, 6) if a] + [8 * 6 + b for b in range(1, 6)]] = 1
_LED_STARTS[[8 * a + b for a in (0, 6) for b in (0, 6)]] = 2
_LED_STARTS[[8 * a + b for a in (1, 2, 3) for b in (1, 2, 3) if a != b] + [8 * 1 + 4, 8 * 3 + 4, 8 * 4 + 3]] = 1
#: Lead bytes whose characters of two bytes are letters (Latin, Cyrillic), but for the signs 0xC3 0x97 and 0xC3 0xB7.
_LED_LEADS = np.zeros(256, np.uint8)
_LED_LEADS[[*range(0xC3, 0xCB), 0xD0, 0xD1, 0xD3]] = 1
#: By kind, what a stretch of it alone, after a space or not, adds up to.
_LED_BITS = np.array([0, 1, 2, 4, 8, 8, 8] + [8] * 249, np.uint8)


def _led_kinds(data: np.ndarray) -> np.ndarray:
    """The kinds of the bytes of whole characters."""
    kind = _mapped(data, _LED)
    at = np.flatnonzero(_mapped(data, _LED_LEADS).view(bool))
    if len(at):
        second = data[at + 1]
        at = at[(data[at] != 0xC3) | ((second != 0x97) & (second != 0xB7))]
        kind[at] = kind[at + 1] = 1
    return kind


def _led_stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The stretches of texts without nulls, as bytes, and how many there are up to each text's start and the end.

    For byte-level models with the pattern ``'s|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    a token never crosses their edges: changes between letters, signs and digits
    of known kind, and white space, whose last space goes with what follows.  An
    apostrophe stays with the letters after it, which may be one token with it.
    """
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, raw = texts.buffers()
    edges = np.frombuffer(places, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    edges -= edges[0]
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(edges), np.int64)
    kind = np.append(_led_kinds(data), np.uint8(6))  # a last kind that ends all
    start = np.empty(len(data), np.uint8)
    start[1:] = _mapped((kind[:-2] << np.uint8(3)) | kind[1:-1], _LED_STARTS)
    first = edges[edges < len(data)]
    start[first] = 1
    at = np.flatnonzero(start == 2)
    if len(at):  # the last of a run, unless the text ends there
        last = (kind[at + 1] != 0) & (kind[at + 1] != 6)
        ends = np.searchsorted(first, at + 1)
        last &= (ends == len(first)) | (first.take(ends, mode="clip") != at + 1)
        start[at] = last
    if (data >= 0xC2).any():  # white space beyond ASCII: these texts are cut by the pattern
        far = pc.match_substring_regex(texts, _FAR_SPACE)
        for k in np.flatnonzero(far.to_numpy(zero_copy_only=False)).tolist():
            a, b = edges[k : k + 2].tolist()
            sizes = [len(w.encode()) for w in SPACED_WORDS.findall(texts[k].as_py())]
            start[a:b] = 0
            start[a + np.cumsum([0, *sizes[:-1]])] = 1
    here = np.flatnonzero(start.view(bool))
    found = pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer(np.append(here, len(data)).astype(np.int32)), pa.py_buffer(data)])
    return found, np.searchsorted(here, edges)


def _pieces(texts: pa.Array, most: int = 4 << 20) -> list[pa.Array]:
    """Consecutive texts of about so many bytes; numpy takes some twenty times their memory."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = np.searchsorted(sizes, np.arange(most, sizes[-1] if len(sizes) else 0, most)) + 1
    edges = [0, *np.unique(edges).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


class WordCache:
    """Ids of texts by a ``tokenizers`` model, each distinct word encoded once.

    Exact where the model's pre-tokenizer never joins what ``words`` separates;
    the tests compare it with whole-text encoding.  The cache holds two
    generations of at most ``limit`` words; a word that is met again moves to
    the younger one, so frequent words stay.  For models whose stretches are
    known these are held instead, twice ``limit`` of them; then only those of
    the batch at hand stay.
    """

    #: New words are encoded so many at a time, with this word between them.
    JOINED, SEPARATOR = 64, " |"

    def __init__(self, path: str, words: re.Pattern, limit: int = 600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words, self.limit = words, limit
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.spaced = words.pattern == SPACED_WORDS.pattern
        # a model that lower-cases gives the same ids for a text in lower case
        self.lower = not self.spaced and "Lowercase" in json.dumps(json.loads(self.model.to_str())["normalizer"])
        # letters in lower case are one token's stretch for such a pattern and need no more than composing
        self.plain = self.model
        if self.lower and r"[\\p{L}]+|[\\p{N}]|" in json.dumps(json.loads(self.model.to_str())["pre_tokenizer"]):
            self.plain = Tokenizer.from_str(self.model.to_str())
            self.plain.normalizer = normalizers.NFC()
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.between = self._ids(self.SEPARATOR)[0] if len(self._ids(self.SEPARATOR)) == 1 else None
        # models whose stretches are known and whose tokens tell where one ends
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.stretched = bool(suffix) and self.plain is not self.model and _PATTERN in json.dumps(json.loads(self.model.to_str())["pre_tokenizer"])
        if self.stretched:
            self.bare = Tokenizer.from_str(self.plain.to_str())
            self.bare.normalizer = normalizers.Sequence([])
            vocab = self.model.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[k for token, k in vocab.items() if token.endswith(suffix)]] = True
        # byte-level models with the usual pattern, whose tokens tell where a space starts one
        self.led = self.spaced and self._is_byte_level()
        if self.led:
            self.bare = Tokenizer.from_str(self.model.to_str())
            self.bare.encode_special_tokens = True
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)])
            vocab = self.model.get_vocab()
            self.leads = np.zeros(max(vocab.values()) + 1, bool)
            self.leads[[k for token, k in vocab.items() if token.startswith("\u0120")]] = True  # the sign for a space
            self.line = self._ids("\n")[0]
        if self.stretched or self.led:
            self._forget()

    def _is_byte_level(self) -> bool:
        told = json.loads(self.model.to_str())
        cut, own = told["pre_tokenizer"] or {}, told["model"]
        plain = told["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        whole = own.get("type") == "BPE" and not own.get("dropout") and not own.get("continuing_subword_prefix") and not own.get("end_of_word_suffix")
        # added tokens that are not special would be cut out of the text first
        return bool(plain and whole and all(t["special"] for t in told["added_tokens"]) and len(self._ids("\n")) == 1)

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _letters(self, word: str) -> bool:
        """Whether the model's patterns see letters alone: some letters become a letter and a mark by its normalizer."""
        if word.isascii() or not word.isalpha():
            return word.isalpha()
        return self.model.normalizer is None or self.model.normalizer.normalize_str(word).isalpha()

    def _cut(self, text: str) -> list[str]:
        if self.lower and "İ" not in text and "Σ" not in text:  # Python looks at their context
            text = text.lower()
        if self.spaced:
            return spaced_words(text)
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()  # the same white space but for these four
        return self.words.findall(text)

    def _learn(self, new: set[str]) -> None:
        """Encodes new words; letters with signs at their end are two tokens' stretches, each met more often."""
        ended = []
        for w in new:
            base = w.rstrip(SIGNS)
            if len(base) < len(w) and self._letters(base[self.spaced and base[:1] == " " :]):
                ended.append((w, base, w[len(base) :]))
        if ended:
            parts = {x for _, a, b in ended for x in (a, b)}
            old = self.old  # set.intersection would run through all of a dict
            self.known.update([(w, old[w]) for w in parts if w in old])
            self._encode(list((new.difference([w for w, _, _ in ended]) | parts).difference(self.known)))
            known = self.known
            known.update([(w, known[a] + known[b]) for w, a, b in ended])
        else:
            self._encode(list(new))

    def _encode(self, new: list[str]) -> None:
        if self.plain is self.model:
            return self._encode_by(self.model, new)
        letters = [w for w in new if w == w.lower() and self._letters(w)]
        self._encode_by(self.plain, letters)
        self._encode_by(self.model, list(set(new).difference(letters)))

    def _encode_by(self, model, new: list[str]) -> None:
        known, single = self.known, []
        if self.between is not None:
            # a word that starts with its space can be told from the separator on either side
            single = [w for w in new if self.spaced and (w[0] != " " or len(w) < 2 or w.isspace())]
            joined = [w for w in new if w[0] == " " and len(w) > 1 and not w.isspace()] if self.spaced else new
            groups = [joined[k : k + self.JOINED] for k in range(0, len(joined), self.JOINED)]
            glue = self.SEPARATOR if self.spaced else self.SEPARATOR + " "
            for group, e in zip(groups, model.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                at = np.flatnonzero(ids == self.between)
                if len(at) != len(group) - 1:  # a word that holds the separator's id
                    single += group
                    continue
                raw, at = ids.tobytes(), (4 * at).tolist()
                known.update(zip(group, [raw[a:b] for a, b in zip([0, *[x + 4 for x in at]], [*at, len(raw)])]))
        else:
            single = new
        for w, e in zip(single, model.encode_batch_fast(single, add_special_tokens=False)):
            known[w] = np.array(e.ids, np.uint32).tobytes()

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of words, each given once."""
        found = list(map(self.known.get, words))
        new = {w for w, x in zip(words, found) if x is None}
        if not new:
            return found
        if len(self.known) + len(new) > self.limit:
            self.old, self.known = self.known, {}
        if self.old:
            again = [w for w in new if w in self.old]
            self.known.update([(w, self.old[w]) for w in again])
            new.difference_update(again)
        if new:
            self._learn(new)
        known = self.known
        return [known[w] if x is None else x for w, x in zip(words, found)]

    def _forget(self) -> None:
        """Empties what is known of stretches: their numbers, where each one's ids start in flat, and how many they are."""
        self.number: dict[str, int] = {}
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _numbers(self, found: pa.Array) -> np.ndarray:
        """The numbers of distinct stretches; new ones are learned."""
        words = found.to_numpy(zero_copy_only=False).tolist()  # some times faster than to_pylist
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        if len(self.number) + len(new) > 2 * self.limit:
            self._forget()
            new = np.arange(len(words))
        for part, learn in self._learners(found, new):
            if len(part):
                own = [words[k] for k in part.tolist()]
                sizes, ids = learn(own)
                at[part] = np.arange(len(self.at), len(self.at) + len(own))
                self.number.update(zip(own, at[part].tolist()))
                _extend(self.at, len(self.flat) + np.cumsum(sizes) - sizes)
                _extend(self.size, sizes)
                _extend(self.flat, ids)
        return at

    def _learners(self, found: pa.Array, new: np.ndarray) -> list[tuple[np.ndarray, Callable]]:
        """The new ones of the found stretches by how their ids are learned."""
        _, places, raw = found.buffers()
        places = np.frombuffer(places, np.int32)[found.offset : found.offset + len(found) + 1]
        raw = np.frombuffer(raw, np.uint8)[: places[-1]]
        kinds = _mapped(_led_kinds(raw), _LED_BITS) if self.led else _mapped(raw, _KIND_SECOND)
        kinds = np.bitwise_or.reduceat(kinds, places[:-1])[new]
        if self.led:
            one = (raw[places[new]] == 32) & ((kinds == 1) | (kinds == 2) | (kinds == 4))
            return [(new[one], self._led_ids), (new[~one], self._lined_ids)]
        letters = kinds == _LETTER
        return [(new[letters], self._letters_ids), (new[~letters], self._other_ids)]

    def _led_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words has, and their ids, for a space and letters, signs or digits alone."""
        done = self.bare.encode_batch_fast([b"".join(words[k : k + 512]).decode() for k in range(0, len(words), 512)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in done])
        starts = np.flatnonzero(self.leads[ids])
        return (np.diff(starts, append=len(ids)), ids) if len(starts) == len(words) else self._lined_ids(words)

    def _lined_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any words: in lines, white space by itself."""
        texts = [w.decode() for w in words]
        blank = np.fromiter(map(str.isspace, texts), bool, len(texts))
        sizes, ids = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)] * len(texts)
        lined = np.flatnonzero(~blank).tolist()
        groups = [lined[k : k + self.JOINED] for k in range(0, len(lined), self.JOINED)]
        alone = np.flatnonzero(blank).tolist()
        for group, e in zip(groups, self.model.encode_batch_fast(["\n".join([texts[k] for k in g]) for g in groups], add_special_tokens=False)):
            own = np.array(e.ids, np.uint32)
            parts = np.split(own, np.flatnonzero(own == self.line))
            if len(parts) != len(group):
                alone += group
                continue
            for k, part in zip(group, [parts[0], *[p[1:] for p in parts[1:]]]):
                ids[k] = part
        for k, e in zip(alone, self.model.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False)):
            ids[k] = np.array(e.ids, np.uint32)
        sizes[:] = [len(x) for x in ids]
        return sizes, np.concatenate(ids)

    def _letters_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the words has, and their ids, for letters in lower case that need no composing."""
        done = self.bare.encode_batch_fast([" ".join(words[k : k + 512]) for k in range(0, len(words), 512)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in done])
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (np.diff(ends, prepend=0), ids) if len(ends) == len(words) else self._other_ids(words)

    def _other_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self._encode(words)
        raw = [self.known.pop(w) for w in words]
        return np.fromiter(map(len, raw), np.int64, len(raw)) >> 2, np.frombuffer(b"".join(raw), np.uint32)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """An array of uint32 ids for each text."""
        if self.stretched or self.led:
            return self.encode_column(pa.array(texts, pa.string()))
        out = []
        for start in range(0, len(texts), 64):
            cut = [self._cut(t) for t in texts[start : start + 64]]
            own = list(set().union(*cut))
            ids = dict(zip(own, self._look_up(own)))
            out += [np.frombuffer(b"".join(map(ids.__getitem__, words)), np.uint32) for words in cut]
        return out

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """The same for an Arrow array (null: empty).

        Where the model's stretches are known, numpy cuts them and Arrow numbers
        them, so only distinct ones become Python objects.
        """
        texts = pc.fill_null(texts, "")
        if not (self.stretched or self.led):
            return self.encode_batch(texts.to_pylist())
        return [ids for part in (_pieces(texts) if self.led else [texts]) for ids in self._encode_cut(part)]

    def _encode_cut(self, texts: pa.Array) -> list[np.ndarray]:
        cut, edges = _led_stretches(texts) if self.led else _stretches(texts)
        coded = cut.dictionary_encode()
        at = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        counts = self.size[at]
        ends = np.cumsum(counts, dtype=np.int64)
        ids = self.flat[np.repeat(self.at[at] - (ends - counts), counts) + np.arange(len(ends) and ends[-1])]
        return np.split(ids, np.r_[0, ends][edges[1:-1]])[: len(texts)]


def _extend(array: np.ndarray, more: np.ndarray) -> None:
    """Lengthens an array that nothing else looks into, in place."""
    n = len(array)
    array.resize(n + len(more), refcheck=False)
    array[n:] = more


_caches: dict[tuple, WordCache] = {}


def word_cache(path: str, words: re.Pattern, limit: int = 600_000) -> WordCache:
    """One cache for each Python worker and model."""
    key = (path, words.pattern)
    if key not in _caches:
        _caches[key] = WordCache(path, words, limit)
    _caches[key].limit = limit
    return _caches[key]
