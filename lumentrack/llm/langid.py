"""Language identification by cross-parsing entropy.

A text is cut, from left to right, into the longest phrases that occur in a language's labelled text. The suffix
automaton of that text finds them in one walk. The language that needs the fewest phrases wins. Its bits for each
letter charge every phrase a pointer into the longest sample, whichever language's it is: a shorter sample finds
shorter phrases, and must not make them cheaper.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrack.llm.texts import flat

#: The sample that the automata are built on: so many characters for each language, of a document a window of at most so many.
TRAIN_CHARS, DOC_CHARS = 40_000, 4_000
UNKNOWN = "und"
#: Symbols: 0 parts words, 1 to 26 are a to z, other letters share the rest by code point.
SYMBOLS = 96
_WEIGHT_BIT = 29
#: Languages are parsed in groups whose tables have at most so many entries (4 bytes each) together.
GROUP_ENTRIES = 1 << 26


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(len(table)):
        if not 0xD800 <= cp < 0xE000 and (c := chr(cp)).isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return table


_tables: dict[str, np.ndarray] = {}


#: So many bytes of text are made symbols at once, which takes some twenty-five times as much memory.
SYMBOL_BYTES = 1_000_000


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols in a row and their n + 1 offsets: letters without case, with one 0 for what stands between words."""
    if "symbols" not in _tables:
        _tables["symbols"] = _symbol_table()
    per = max(1, int(len(texts) * SYMBOL_BYTES / max(1, texts.nbytes)))
    parts = [_symbols(texts.slice(i, per)) for i in range(0, len(texts), per)]
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.concatenate([s for s, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in parts]))])


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(texts)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != chars[-1]:  # not UTF-8 after all: text by text
        parts = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts.cast(pa.large_binary()).fill_null(b"").to_pylist()]
        chars, points = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts)
    s = _tables["symbols"][points]
    before = np.concatenate([[0], s[:-1]]).astype(np.uint8) if len(s) else s
    before[chars[:-1][chars[:-1] < len(s)]] = 0
    keep = (s != 0) | (before != 0)
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[chars]


def suffix_automaton(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Transitions (state, symbol, next state) and number of states of the smallest automaton whose paths from state 0 are the substrings."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sequence.tolist():
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:  # q's shorter substrings get a state of their own
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    states = np.repeat(np.arange(len(nexts), dtype=np.int32), [len(n) for n in nexts])
    return states, np.fromiter((c for n in nexts for c in n), np.uint8, len(states)), np.fromiter((t for n in nexts for t in n.values()), np.int32, len(states)), len(nexts)


@dataclass(frozen=True)
class Model:
    """Languages in code point order, the length of each one's labelled text, and its automaton as packed arrays."""

    langs: tuple[str, ...]
    lengths: tuple[int, ...]
    automata: tuple[tuple[bytes, bytes, bytes, int], ...]


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", train_chars: int = TRAIN_CHARS, doc_chars: int = DOC_CHARS) -> Model:
    """Builds each language's automaton, in a task of its own, on a sample of its documents in hash order.

    Counts cover all rows; the sample's bound (``train_chars`` a language) doesn't grow with them. Of a longer text a
    window of ``doc_chars`` is taken, at a place that a hash of id and text draws. Rows without text or language teach
    nothing; repeated rows are drawn together.
    """
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(id_col, text).alias("h"))
    n = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.least(F.length("text"), F.lit(doc_chars))).alias("chars"))
    # Three times what is used, and thirty documents, so that chance leaves enough.
    share = F.greatest(3.0 * train_chars / F.greatest("chars", F.lit(1)), 30.0 / F.col("docs"))
    shares = n.select("lang", share).collect()  # a row for each label
    if not shares:
        return Model((), (), ())
    of_lang = F.create_map(*[F.lit(x) for r in shares for x in r])
    drawn = known.filter((F.col("h") / float(2**64) + 0.5) <= of_lang[F.col("lang")])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "text"])
        s, at = symbols(pa.array(rows["text"].tolist(), pa.large_string()))
        parts = [x for a, b in zip(at, at[1:], strict=False) for x in (s[a:b], [0])]
        sequence = np.concatenate(parts).astype(np.uint8)[:train_chars] if parts else np.zeros(0, np.uint8)
        states, codes, to, size = suffix_automaton(sequence)
        return pd.DataFrame([{"lang": rows["lang"].iloc[0], "length": len(sequence), "states": states.tobytes(), "codes": codes.tobytes(), "to": to.tobytes(), "size": size}])

    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - doc_chars, F.lit(0)) + 1) + 1
    drawn = drawn.select("lang", F.substring("text", start.cast("int"), F.lit(doc_chars)).alias("text"), "h")
    built = drawn.groupBy("lang").applyInPandas(build, "lang string, length long, states binary, codes binary, to binary, size long").collect()
    built = sorted((r for r in built if r["length"] > 1), key=lambda r: r["lang"].encode())
    return Model(tuple(r["lang"] for r in built), tuple(r["length"] for r in built), tuple((bytes(r["states"]), bytes(r["codes"]), bytes(r["to"]), r["size"]) for r in built))


class Parser:
    """The languages' automata as tables: row of a state, column of a symbol, in it the next row and the phrases that end.

    A group of languages shares one table. More than one group's tables aren't kept but made again for each batch, so
    that memory doesn't grow with the number of languages.
    """

    def __init__(self, model: Model, group_entries: int = GROUP_ENTRIES):
        self.model = model
        used = np.unique(np.concatenate([np.frombuffer(a[1], np.uint8) for a in model.automata]))
        self.column = np.zeros(SYMBOLS, np.uint8)  # column 0: in no language's text
        self.column[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.groups: list[list[int]] = []
        room = 0
        for i, (*_, size) in enumerate(model.automata):
            if size * self.width >= 1 << _WEIGHT_BIT:
                raise ValueError(f"the sample of {model.langs[i]!r} is too long: {size} states of {self.width} symbols")
            if not self.groups or size * self.width > room:
                self.groups.append([])
                room = min(group_entries, 1 << _WEIGHT_BIT)
            self.groups[-1].append(i)
            room -= size * self.width
        self.kept = self._table(self.groups[0]) if len(self.groups) == 1 else None

    def _table(self, group: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """A group's table and where each language's begins."""
        tables, roots, base, width = [], [], 0, self.width
        for i in group:
            states, codes, to, size = self.model.automata[i]
            s, c, t = np.frombuffer(states, np.int32), self.column[np.frombuffer(codes, np.uint8)].astype(np.int32), np.frombuffer(to, np.int32)
            # Where a path ends, a phrase does, and the symbol begins the next; one that the text lacks is a phrase alone.
            root = np.full(width, base * width | 2 << _WEIGHT_BIT, np.int32)
            first = s == 0
            root[c[first]] = (base + t[first]) * width | 1 << _WEIGHT_BIT
            table = np.tile(root, (size, 1))
            table[0] = base * width | 1 << _WEIGHT_BIT
            table[s, c] = (base + t) * width
            tables.append(table.ravel())
            roots.append(base * width)
            base += size
        return np.concatenate(tables), np.array(roots, np.int32)

    def phrases(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each text (columns) by each language (rows)."""
        return np.concatenate([self._phrases(s, at, *(self.kept or self._table(group))) for group in self.groups])

    def _phrases(self, s: np.ndarray, at: np.ndarray, table: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """All texts take a step at a time, the longest first."""
        order = np.argsort(-np.diff(at), kind="stable")
        lengths = np.diff(at)[order]
        codes = self.column[s]
        position = at[:-1][order].copy()
        state = np.repeat(roots[:, None], len(order), axis=1)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        mask = (1 << _WEIGHT_BIT) - 1
        for n in active.tolist():
            now = state[:, :n]
            step = table.take(now + codes.take(position[:n]))
            count[:, :n] += step >> _WEIGHT_BIT
            np.bitwise_and(step, mask, out=now)
            position[:n] += 1
        out = np.empty_like(count)
        # After a symbol that is a phrase alone, no other has begun.
        out[:, order] = count + ((lengths > 0) & (state != roots[:, None]))
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits a letter of the best language for each text."""
        s, at = symbols(texts)
        n = np.diff(at)
        bits = self.phrases(s, at) * np.log2(float(max(self.model.lengths))) / np.maximum(n, 1)
        best = bits.argmin(axis=0)
        low = bits[best, np.arange(len(n))]
        second = np.partition(bits, 1, axis=0)[1] if len(bits) > 1 else np.full(len(n), np.inf)
        score = np.where(n > 0, 1 - low / np.maximum(second, 1e-12), 0.0)
        return [self.model.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)], score, np.where(n > 0, low, np.inf)


_parsers: dict[int, Parser] = {}
_BATCH_BYTES = 8_000_000


def identify(docs: DataFrame, model: Model, columns: list[Column], *, text: str = "text", at: int | None = None) -> DataFrame:
    """``columns`` of ``docs`` with lang_pred, score (0 where two languages are as near, towards 1 the clearer) and bits.

    Null texts and texts without a letter are ``und`` with score 0 and infinite bits, as are all texts if no language
    was learnt. Where two languages need as few phrases, the first in code point order is named. Repeated rows are
    judged alike. Long texts are read whole. With ``at`` the texts are the column of that place in ``columns``, so that they
    aren't passed to the workers twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: about 20 bytes a character of it
    rows = docs.select(*columns, *([F.col(text).alias("_text")] if at is None else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        if found.langs and id(found) not in _parsers:
            _parsers.clear()
            _parsers[id(found)] = Parser(found)
        for whole in batches:
            per = max(1, int(whole.num_rows * _BATCH_BYTES / max(1, whole.nbytes)))
            for i in range(0, whole.num_rows, per):
                batch = whole.slice(i, per)
                if found.langs:
                    langs, score, bits = _parsers[id(found)].predict(batch.column(batch.num_columns - 1 if at is None else at))
                else:
                    langs, score, bits = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.full(batch.num_rows, np.inf)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], names=[*names, "lang_pred", "score", "bits"])

    out = rows.drop("_text") if at is None else rows.select("*")
    names = out.columns
    schema = out.schema.add("lang_pred", "string").add("score", "double").add("bits", "double")
    return rows.mapInArrow(run, schema)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))


def predicted(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out (fold 1 of 3, never learnt from), lang_pred, score, bits. An empty table gives an empty result."""
    held_out = fold(id_col, 3) == 1
    model = train(docs.filter(~held_out), text=text, lang=lang, id_col=id_col, **options)
    return identify(docs, model, [F.col(id_col).alias("doc_id"), held_out.alias("held_out")], text=text)


#: A text is rejected that takes this many bits a letter or more even in its best language, as random letters do.
REJECT_BITS = 8.0


def accepted(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", reject_bits: float = REJECT_BITS) -> DataFrame:
    """``docs`` with all its columns, less the rows without a letter and those that are in none of the learnt languages."""
    model = train(docs.filter(fold(id_col, 3) != 1), text=text, lang=lang, id_col=id_col)
    kept = ["lang_pred", "score", "bits"]
    inside = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    found = identify(docs, model, inside, text=text, at=[c.lower() for c in docs.columns].index(text.lower())).filter((F.col("lang_pred") != UNKNOWN) & (F.col("bits") < reject_bits)).drop(*kept)
    return found.toDF(*docs.columns)
