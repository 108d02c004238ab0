"""Language identification by cross-parsing entropy.

For each language a suffix automaton of its labelled text is built.  A text is parsed greedily into
the longest phrases that occur in the labelled text; the language that needs the fewest phrases a
character wins, as its text predicts the text best.

The automaton becomes a table (state, character) -> next state, where a character that can't go on
opens a new phrase and sets the table's highest bit.  Parsing is then one gather a character, done for
many pieces of text side by side in numpy: texts are cut into lanes of ``LANE`` characters that are parsed
at once from the start state, then each lane again from the state its predecessor ended in, until that
state is the one the first parse had at the same place; from there on both are the same.  So phrases are
those of the whole text parsed from its begin.

Only letters matter: they are folded to lower case, all else is one blank.  Each language's alphabet is that
of its labelled text; other letters open a phrase each.

The model is fitted on a bounded sample of labelled rows, and learns every value of lang.  Of each language the
``SAMPLE_DOCS`` documents first by a hash of the id are taken; they share ``MODEL_CHARS`` characters evenly, a
longer text giving pieces spread over all of it.  Where languages are many or alphabets large, each language has
fewer characters, so that all tables together have at most ``MODEL_CELLS`` entries.  As many documents again are
held out of the model, to learn which rates of phrases texts in a known language have.  Whole texts are always scored.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the language
with most labelled rows, then the first by name; a null lang isn't learned; without any labelled row all texts are
``und``; repeated rows are each returned; a null doc_id is kept and isn't held out; very long texts are parsed in
waves of bounded size; an empty table gives an empty result; other columns are passed on by ``identify``'s keep
list only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

SAMPLE_DOCS, MODEL_CHARS, MODEL_CELLS = 64, 30_000, 1 << 26
#: Pieces that a text gives which is longer than its share.
PIECES = 8
LANE = 512
#: A new phrase is due; the rest of the entry is the next state times the alphabet's size.
_NEW = np.uint32(1 << 31)
#: Characters parsed side by side at once.
_WAVE = 1 << 19
_BLANK, _OTHER = 0, 1
#: Documents of a language held out of the model, and values of lang that can be learned: more are an error.
HELD_OUT_DOCS, MOST_LANGUAGES = 32, 4096
#: At this rate phrases are hardly longer than a character, whatever the text's length.
NO_LANGUAGE, FEW_LETTERS = 0.75, 40


def fold(text: str) -> str:
    """Letters in lower case; every run of other characters is one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: list[int], size: int) -> np.ndarray:
    """Transitions (state, character) of the suffix automaton of text; -1 where there is none."""
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    table = np.full((len(follow), size), -1, np.int64)
    for state, edges in enumerate(follow):
        for c, to in edges.items():
            table[state, c] = to
    return table


class Model:
    """Parsing tables of several languages.

    worst: the rate of phrases that long texts in a known language stay below; see ``most_rate``.
    """

    def __init__(self, texts: dict[str, str], cells: int = MODEL_CELLS) -> None:
        self.languages = list(texts)
        self.worst = NO_LANGUAGE
        folded = {lang: _fitting(fold(text), cells // max(len(texts), 1)) for lang, text in texts.items()}
        letters = sorted({c for text in folded.values() for c in text} - {" "})
        code = {c: k for k, c in enumerate(letters, 2)}
        self.tables = []
        for lang in self.languages:
            own = sorted(set(folded[lang]) - {" "})
            own_code = {c: k for k, c in enumerate(own, 2)}
            size = len(own) + 2
            table = suffix_automaton([own_code.get(c, _BLANK) for c in folded[lang]], size)
            # the last state has read nothing yet, or a letter that the labelled text lacks: all that follows is new
            table = np.vstack((table, np.full((1, size), -1)))
            missing = table < 0
            root = np.where(table[0] < 0, len(table) - 1, table[0])
            table = np.where(missing, root, table) * size
            local = np.full(len(letters) + 2, _OTHER, np.uint32)
            local[_BLANK] = _BLANK
            local[[code[c] for c in own]] = np.arange(2, size)
            self.tables.append(((table.astype(np.uint32) | np.where(missing, _NEW, np.uint32(0))).ravel(), local, np.uint32(len(table) * size - size)))
        # every code point of the basic plane: a letter of some alphabet, another letter, or a blank
        self.plane = np.full(1 << 16, _BLANK, np.uint16)
        for point in range(1 << 16):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                self.plane[point] = code.get(low, _OTHER) if len(low) == 1 else _OTHER

    def encode(self, text: str) -> np.ndarray:
        """Codes of the text's letters with single blanks between words, none at the ends."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        high = points > 0xFFFF
        codes = self.plane[np.where(high, 0, points)]
        if high.any():
            codes[high] = [_OTHER if chr(p).isalpha() else _BLANK for p in points[high]]
        blank = codes == _BLANK
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        codes = codes[keep]
        if len(codes) and codes[0] == _BLANK:
            codes = codes[1:]
        return codes[:-1] if len(codes) and codes[-1] == _BLANK else codes

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs in each language (texts x languages)."""
        lanes = [codes[k : k + LANE] for codes in texts for k in range(0, len(codes), LANE)]
        owner = np.repeat(np.arange(len(texts)), [-(-len(codes) // LANE) for codes in texts])
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        width = _WAVE // LANE
        ends: list = [None] * len(self.languages)
        for k in range(0, len(lanes), width):
            wave, of = lanes[k : k + width], owner[k : k + width]
            follows = np.concatenate(([k > 0 and owner[k - 1] == of[0]], of[1:] == of[:-1]))
            lengths = np.array([len(x) for x in wave])
            order = np.argsort(-lengths, kind="stable")  # lanes in falling length: those still running are the first ones
            grid = np.zeros((lengths[order[0]], len(wave)), np.uint16)
            for column, lane in enumerate(order):
                grid[: lengths[lane], column] = wave[lane]
            for language in range(len(self.tables)):
                counts, ends[language] = self._wave(language, grid, lengths[order], order, follows, ends[language])
                np.add.at(out[:, language], of, counts)
        return out

    def _wave(self, language: int, grid: np.ndarray, lengths: np.ndarray, order: np.ndarray, follows: np.ndarray, before: np.uint32 | None) -> tuple[np.ndarray, np.uint32]:
        """Phrases of each lane, and the state after the last one; ``before`` is the state before the first one, if it follows.

        Columns of grid are lanes in the order given; follows says which lanes go on from the one before.
        """
        table, local, start = self.tables[language]
        codes = local[grid]
        lane_count = len(order)
        column_of = np.empty(lane_count, np.int64)
        column_of[order] = np.arange(lane_count)
        begin = np.full(lane_count, start, np.uint32)
        if follows[0]:
            begin[column_of[0]] = before
        entries = np.zeros(grid.shape, np.uint32)
        state = begin.copy()
        running = np.searchsorted(-lengths, -np.arange(len(grid)), "left")
        for row, n in enumerate(running):
            entry = table[state[:n] + codes[row, :n]]
            entries[row, :n] = entry
            state[:n] = entry & ~_NEW
        opened = np.cumsum(entries >> np.uint32(31), axis=0, dtype=np.int32)
        count, end = opened[-1].copy(), state
        first_end = end.copy()
        # lanes whose first parse began elsewhere: parse again until both parses are in one state
        todo = np.flatnonzero(follows[1:]) + 1
        while len(todo):
            columns = column_of[todo]
            now, new = end[column_of[todo - 1]], np.zeros(len(todo), np.int32)
            total, fresh = np.zeros(len(todo), np.int32), np.zeros(len(todo), np.uint32)
            alive, row = np.arange(len(todo)), 0
            while len(alive):
                at = columns[alive]
                entry = table[now[alive] + codes[row, at]]
                new[alive] += (entry >> np.uint32(31)).astype(np.int32)
                now[alive] = entry & ~_NEW
                same, over = now[alive] == entries[row, at] & ~_NEW, lengths[at] == row + 1
                met, ended = alive[same], alive[over & ~same]
                total[met] = new[met] + opened[-1, columns[met]] - opened[row, columns[met]]
                fresh[met] = first_end[columns[met]]
                total[ended], fresh[ended] = new[ended], now[ended]
                alive, row = alive[~(same | over)], row + 1
            count[columns] = total
            # the lane after one that ends in another state than was thought begins in another one
            todo = todo[fresh != end[columns]] + 1
            end[columns] = fresh
            todo = todo[todo < lane_count]
            todo = todo[follows[todo]]
        return count[column_of], end[column_of[-1]]

    def most_rate(self, letters: np.ndarray) -> np.ndarray:
        """Phrases a letter from which on a text of so many letters is in no known language; short ones tell little."""
        return self.worst + (NO_LANGUAGE - self.worst) * np.minimum(1, FEW_LETTERS / np.maximum(letters, 1))


def _fitting(text: str, cells: int) -> str:
    """The text as far as its parsing table has room: at most two states a character, each with an entry a letter."""
    letters: set[str] = set()
    for n, c in enumerate(text):
        letters.add(c)
        if 2 * (n + 1) * (len(letters) + 2) > cells:
            return text[:n]
    return text


def rates(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases a character, by text and language (infinite for texts without a letter), and the texts' characters."""
    codes = [model.encode(t or "") for t in texts]
    n = np.array([len(c) for c in codes], np.int64)
    counts = model.phrases(codes)
    return np.where(n[:, None] > 0, counts / np.maximum(n, 1)[:, None], np.inf), n


def _spread(text: str, most: int) -> str:
    """Text of at most so many characters; of a longer one pieces spread over all of it."""
    if len(text) <= most:
        return text
    size = max(most // PIECES - 1, 1)
    return " ".join(text[k * (len(text) - size) // (PIECES - 1) :][:size] for k in range(PIECES))


def _spread_column(text: Column, most: Column) -> Column:
    """The same as an expression."""
    size = F.greatest(F.floor(most / PIECES) - 1, F.lit(1)).cast("int")
    begin = lambda k: F.floor(k * (F.length(text) - size) / (PIECES - 1)).cast("int") + 1
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(F.transform(F.array(*map(F.lit, range(PIECES))), lambda k: F.substr(text, begin(k), size)), " "))


def _even_share(lengths: list[int], most: int) -> int:
    """The largest share such that texts cut to it have at most ``most`` characters together."""
    left, share = most, 0
    for k, n in enumerate(sorted(lengths)):
        share = left // (len(lengths) - k)
        if n > share:
            return share
        left -= n
    return max(lengths, default=0)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on the bounded sample described above; labelled rows have key, text and lang."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(F.trim(text)) > 0))
    counts = rows.groupBy(F.col(lang).alias("lang")).count().limit(MOST_LANGUAGES + 1)
    counts = sorted((-r["count"], r["lang"]) for r in counts.collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # no document gives more than four times its even share
    most = [(lang, 4 * MODEL_CHARS // min(-n, 4 * SAMPLE_DOCS) if n < -4 else MODEL_CHARS) for n, lang in counts]
    known = labelled.sparkSession.createDataFrame(most, "lang string, most int")
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(key).alias("h"), F.col(text).alias("text")).join(F.broadcast(known), "lang")
    rows = rows.select("lang", "h", _spread_column(F.col("text"), F.col("most")).alias("text"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    sample: dict[str, list[str]] = {lang: [] for _, lang in counts}
    for row in sorted(rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SAMPLE_DOCS + HELD_OUT_DOCS).collect(), key=lambda r: (r.lang, r.k)):
        sample[row.lang].append(row.text)
    texts, held = {}, []
    for language, found in sample.items():
        n = min(SAMPLE_DOCS, max(len(found) - HELD_OUT_DOCS, -(-3 * len(found) // 4)))
        share = _even_share([*map(len, found[:n])], MODEL_CHARS)
        texts[language] = " ".join(_spread(t, share) for t in found[:n])
        held += found[n:]
    model = Model(texts)
    if held:
        rate, letters = rates(model, held)
        long = letters >= 100
        if long.any():
            model.worst = min(NO_LANGUAGE, 2 * float(np.quantile(rate[long].min(axis=1), 0.99)))
    return model


def identify(docs: DataFrame, model: Model, keep: list, text: str = "text") -> DataFrame:
    """The kept columns and lang_pred, score (0 to 1: how far the second language is behind), rate, known.

    rate: phrases after the first, a letter; known: whether that is less than of texts in no language of the model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def f(texts: list[bytes | None]) -> list[list]:
            if not model.languages:
                return [["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [False] * len(texts)]
            rate, n = rates(model, [None if t is None else t.decode("utf-8", "replace") for t in texts])
            best = rate.argmin(axis=1)
            ranked = np.sort(rate, axis=1)
            second = ranked[:, 1] if rate.shape[1] > 1 else np.ones(len(texts))
            found = np.isfinite(ranked[:, 0])
            later = np.where(found, ranked[:, 0], 0) - 1 / np.maximum(n, 1)
            with np.errstate(invalid="ignore"):
                score = np.where(found, np.clip(1 - ranked[:, 0] / np.maximum(second, 1e-12), 0, 1), 0.0)
            return [
                [model.languages[b] if ok else "und" for b, ok in zip(best, found)],
                score,
                [float(r) if ok else None for r, ok in zip(later, found)],
                found & (later < model.most_rate(n)),
            ]

        return f

    return map_texts(docs, keep, "lang_pred string, score double, rate double, known boolean", make, text=text)


def fold_of(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % parts


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows whose fold of 4 isn't 2, predicted for all."""
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    model = train(docs.filter(~held_out))
    return identify(docs, model, ["doc_id", held_out.alias("held_out")]).drop("rate", "known")


def keep_languages(docs: DataFrame, model: Model) -> DataFrame:
    """docs whose text has a letter and parses as some language of the model.

    Others need twice as many phrases a letter as all but a hundredth of the texts held out of the model, or more
    (``Model.worst``).  A text of few letters tells little: the fewer it has, the nearer its limit is to that of
    phrases hardly longer than a letter; its first phrase isn't counted, so a letter or two stay.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    found = identify(docs, model, [row])
    return found.filter((F.col("lang_pred") != "und") & F.col("known")).select("_row.*")
