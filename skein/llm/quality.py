"""Problem 10: text statistics per document that tell prose from lists, tables and junk.

Each document's statistics are computed where it is read.  Mergeable quantile
sketches (KLL) of every statistic are built per language, over the documents
that fixed bounds of shape let pass (lines that end, few symbols and digits): the
spread of ordinary text in that language, which junk, however much of it there
is, hardly enters.  A value's percentile and robust z-score come from the sketch
of its language; a document is in the tail if any statistic lies ``z`` spreads or
more from the median.  Only documents in the tail are read sentence by sentence.
"""

from __future__ import annotations

import re
from operator import and_, eq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.rows import map_rows
from skein.functions.state import durable
from skein.llm import prose
from skein.llm.languages import LANGUAGES, normal

# Function words.  Those of the first list hold a clause together; those of the second also join names in a list.
STRONG = {
    "en": "the a an is are was were be been has have had do does did not no never will would can could should must may it its this that these those they we you i he she our your their my his her which who whom whose what why how when where while whenever until unless before after because if so than there then even only as to into from at by for of".split(),
    "de": "der die das den dem des ein eine einen einem einer ist sind war wird werden wurde hat haben nicht kein keine es sie wir ich ihr sein seine sich dass weil wenn ob als damit bevor nachdem sobald solange obwohl während durch für von zu zum zur im am vom bei auch nur noch kann muss soll diese dieser dieses wie was warum".split(),
    "fr": "le la les un une des du de au aux l d est sont était a ont pas ne n que qui qu dont où ce cette ces c il elle ils elles nous vous je on se s sa son ses leur leurs pour par dans sur sous car si quand lorsque avant après dès tant sans même puis comme peut doit afin".split(),
    "es": "el la los las un una unos unas del de al es son era está están ha han no que quien cuyo este esta estos estas ese esa lo le se su sus nos me mi por para porque cuando si antes después hasta mientras aunque sin en cuanto como más muy puede debe al".split(),
}
WEAK = {"en": ["and", "or", "but", "with", "without", "in", "on", "nor"], "de": ["und", "oder", "aber", "mit", "ohne", "in", "auf", "an"], "fr": ["et", "ou", "mais", "avec", "en", "à", "y"], "es": ["y", "o", "e", "u", "pero", "con", "a"]}
#: Words after which another of these, or the end, breaks the grammar: articles and the words that cannot follow them.
ARTICLES = frozenset("the a an der die das ein eine einen einem einer le la les un une des el los las una".split())
_NO_NOUN = {
    "en": frozenset("the a an is are was of by and or not under when to with in on at for if that from than as but so into".split()),
    "de": frozenset("der die das den dem ein eine einer einem ist sind nicht und oder von zu mit wenn unter auf bei weil durch für".split()),
    "fr": frozenset("le la les un une des du de est sont ne pas et ou par avec sous quand sur dans pour que qui car".split()),
    "es": frozenset("el la los las un una del de es son no y o por con bajo cuando en para que si porque sobre".split()),
}
_SETS = {n: (frozenset(STRONG[n]), frozenset(STRONG[n]) | frozenset(WEAK[n])) for n in STRONG}
_COMMON = frozenset().union(*(s[1] for s in _SETS.values()))
_ZH = re.compile(r"[的了是在不会和把被对从与而或及可就也都这那我你他它们没有需要如果因为请为什么吗呢]")
_HIRA = re.compile(r"[ぁ-ん]")
_LIST = re.compile(r"^\s*(?:[-*+•–—·▪◦]\s+|\d{1,3}[.)、]\s+|\[[ xX]\]\s+|>\s+|#{1,6}\s+)+(?:\[[ xX]\]\s+)?")
_HTML = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])\s*")
_SPLIT = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_CODE = re.compile(r"[{}\[\]=<>;|\\_$#~^&*+/@]|\w\(|\w\.\w|\w:\w|::|\d\w*[a-zA-Z]|[a-z][A-Z]")
_MARKS = frozenset(".!?。！？:;…")
_MOJIBAKE = re.compile(r"[\u0080-\u009f�]|[ÃÂÅÄâãäåæçèéï][\u0080-\u00bf]|ï¿½")
_STAMP = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|(?:ERROR|WARN|INFO|DEBUG|TRACE)\b|at\s+\S+\s*\(|\w*Error:)")


def _ended(line: str) -> bool:
    """Whether a mark that ends a sentence follows the last word of the line."""
    for c in reversed(line):
        if c in _MARKS:
            return True
        if c.isalnum() or c == "_":
            return False
    return False


def _latin(sentence: str, listed: bool) -> int:
    """1 if the sentence is readable, -1 if it only strings function words together, else 0."""
    tokens = _TOKEN.findall(sentence)
    named = prose.CODE_TOKEN.sub(" Name ", sentence) if prose.MAYBE_CODE.search(sentence) else sentence
    words = [w.lower() for w in _SPLIT.findall(named)]
    n = len(words)
    ended = _ended(sentence)
    if n < 2 or n < 4 and not ended:
        return 0
    code = sum(1 for t in tokens if _CODE.search(t.rstrip(".,;:!?)"))) if _CODE.search(sentence) else 0
    names = words.count("name")
    if code > 0.5 * len(tokens) or names > 0.4 * n:
        return 0
    best, strong, lang = 0, 0, "en"
    for name, (s, both) in _SETS.items():
        c = sum(map(both.__contains__, words))
        if c > best:
            best, strong, lang = c, sum(map(s.__contains__, words)), name
    no_noun = _NO_NOUN[lang]
    bad = sum(1 for a, b in zip(words, words[1:]) if a in ARTICLES and a in no_noun and b in no_noun or a == b != "name" or a in _CONJUNCTIONS and b in _CONJUNCTIONS)
    if words[-1] in no_noun and words[-1] in ARTICLES:
        bad += 1
    if bad > n // 12:
        return -1
    if not strong or best < 0.14 * n or best > 0.75 * n and n > 4:
        return 0
    if listed and n < 5 and not ended:
        return 0
    return int(2.0 <= sum(map(len, words)) / n <= 12)


_CONJUNCTIONS = frozenset("and or und oder et ou y o when under with of is".split())


def _cjk_readable(sentence: str, chars: int) -> bool:
    kana = len(prose.KANA.findall(sentence))
    if chars < 7:
        return False
    if kana:
        return len(_HIRA.findall(sentence)) >= 0.15 * chars
    run = max((len(x) for x in re.findall(r"[㐀-鿿]+", sentence)), default=0)
    return run >= 5 and (bool(_ZH.search(sentence)) or run >= 8)


def readable(text: str) -> int:
    """Non-blank characters of the text that belong to readable sentences."""
    total = 0
    for block in re.split(r"\r?\n[ \t]*\r?\n|\r\r", text):
        lines = re.split(r"\r\n|\n|\r", block) if "\r" in block else block.split("\n")
        joined: list[tuple[str, bool]] = []
        for line in lines:
            if _STAMP.search(line):
                joined.append(("", False))
                continue
            listed = bool(_LIST.match(line))
            plain = _LIST.sub("", line)
            # a line goes on with a sentence if the one before is long and not ended
            if joined and not listed and joined[-1][0] and not _ended(joined[-1][0]) and len(joined[-1][0]) - joined[-1][0].rfind("\n") > 38 and "|" not in plain and "\t" not in plain:
                joined[-1] = (joined[-1][0] + "\n" + plain, joined[-1][1])
            else:
                joined.append((plain, listed))
        good = bad = 0
        for piece, listed in joined:
            if not piece.strip() or _table(piece):
                continue
            if "<" in piece:
                piece = _HTML.sub(" ", piece)
            plain = piece.isascii()
            for s in _END.split(piece):
                if not s.strip() or not plain and len(_MOJIBAKE.findall(s)) * 6 > len(s):
                    continue
                chars = 0 if plain else len(prose.CJK.findall(s))
                visible = len("".join(s.split()))
                if chars * 2 >= sum(map(len, _SPLIT.findall(prose.CJK.sub(" ", s) if chars else s))):
                    total += visible * _cjk_readable(s, chars)
                else:
                    kind = _latin(s, listed)
                    good += visible * (kind == 1)
                    bad += visible * (kind == -1)
        # natural paragraphs have next to no sentence of loose function words; where many are, the others are chance
        total += good if bad < 0.25 * (good + bad) else 0
    return total


def _table(line: str) -> bool:
    """Whether a line is a row of cells."""
    return line.count("\t") >= 2 or line.count("|") >= 2 or "   " in line and len(re.findall(r" {3,}", line.strip())) >= 2 or "," in line and len(re.findall(r"\",|,\"|,\d", line)) >= 3 or line.lstrip().startswith(("{\"", "<table"))


STATISTICS = ("words", "mean_word", "symbol_ratio", "digit_ratio", "ended_lines", "common_words", "common_pairs", "doubled_words", "list_lines", "repeated_lines")
#: Statistics whose tails are looked at, with the side on which a value is out of the ordinary (-1 low, 1 high, 0 both) and the least spread.
TAILS = {"mean_word": (0, 0.3), "symbol_ratio": (1, 0.02), "digit_ratio": (1, 0.02), "ended_lines": (-1, 0.1), "common_words": (0, 0.04), "common_pairs": (1, 0.03), "doubled_words": (1, 0.004), "list_lines": (1, 0.1), "repeated_lines": (1, 0.03)}
#: What ordinary text has at least or at most, whatever its language; the sketches are of such documents.
ORDINARY = {"words": (8, None), "ended_lines": (0.5, None), "list_lines": (None, 0.5), "symbol_ratio": (None, 0.12), "digit_ratio": (None, 0.08), "common_pairs": (None, 0.22), "doubled_words": (None, 0.01)}
Z, LEAST, FEW = 2.0, 0.5, 20
_DIGIT = re.compile(r"\d")


def measure(text: str | None) -> tuple:
    """The statistics of one text; of a null or blank text every number is null but for ``words``, which is 0."""
    if text is None or not text.strip():
        return (0,) + (None,) * (len(STATISTICS) - 1)
    lines = [x for x in re.split(r"\r\n|\n|\r", text) if x.strip()]
    low = text.lower()
    cjk = 0
    if text.isascii():
        digits = sum(map(text.count, "0123456789"))
    else:
        digits = len(_DIGIT.findall(text))
        cjk = len(prose.CJK.findall(text))
        low = prose.CJK.sub(" ", low) if cjk else low
    words = _SPLIT.findall(low)
    n = len(words) + cjk / 1.6
    visible = len("".join(text.split()))
    letters = sum(map(len, words)) + cjk
    known = list(map(_COMMON.__contains__, words))
    common = sum(known) + (len(_ZH.findall(text)) + len(_HIRA.findall(text)) / 2 if cjk else 0)
    return (
        int(n),
        float(letters / n) if n else 0.0,
        max(0, visible - letters - digits) / visible,  # neither blank nor letter nor digit
        digits / visible,
        sum(map(_ended, lines)) / len(lines),
        min(1.0, common / n) if n else 0.0,
        sum(map(and_, known, known[1:])) / max(1, len(words) - 1),
        sum(map(eq, words, words[1:])) / max(1, len(words) - 1),
        sum(1 for x in lines if _LIST.match(x)) / len(lines),
        1 - len({x.strip() for x in lines}) / len(lines),
    )


def readable_share(text: str | None) -> float | None:
    """Share of the non-blank characters that belong to readable sentences; null for a null or blank text."""
    visible = len("".join(text.split())) if text else 0
    return min(1.0, readable(text) / visible) if visible else None


_SCHEMA = "doc_id long, language string, words long, " + ", ".join(f"{s} double" for s in STATISTICS[1:])


def _read(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), normal(F.col("lang")).alias("lang"), "text")


def _language(label: str | None) -> str:
    return label if label in LANGUAGES else "und"


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, language (of the label, ``und`` where it is none of the six) and the statistics of each row."""

    def each(rows):
        for doc_id, lang, text in rows:
            yield (doc_id, _language(lang), *measure(text))

    return map_rows(_read(documents), each, _SCHEMA)


def statistics(documents: DataFrame) -> DataFrame:
    """As ``measured``, with the share of readable characters, which reads every text sentence by sentence."""

    def each(rows):
        for doc_id, lang, text in rows:
            yield (doc_id, _language(lang), *measure(text), readable_share(text))

    return map_rows(_read(documents), each, _SCHEMA + ", readable_share double")


def sketches(stats: DataFrame) -> DataFrame:
    """One KLL sketch of each statistic per language over ordinary documents, and of all languages together (language ``*``), and how many there are.

    Counts and sketches are merged before the shuffle; at most eight rows come out.
    """
    kept = stats.where(F.col("symbol_ratio").isNotNull())
    for name, (low, high) in ORDINARY.items():
        kept = kept.where((F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high))
    both = kept.withColumn("language", F.explode(F.array("language", F.lit("*"))))
    return both.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(F.col(s).cast("double")).alias(s) for s in STATISTICS])


def _grids(made: DataFrame) -> DataFrame:
    """(language, and of each statistic its percentiles 0 to 100) for every language, those of all languages where a language has fewer than ``FEW`` ordinary documents."""
    steps = F.array(*[F.lit(i / 100) for i in range(101)])
    return made.select("language", "n", *[F.kll_sketch_get_quantile_double(s, steps).alias(s) for s in STATISTICS])


def bounds(documents: DataFrame, z: float = Z) -> dict[str, dict[str, tuple[float, float]]]:
    """For each language the values between which a statistic is ordinary; from the sketches, of which at most eight rows reach the driver."""
    rows = {r.language: r for r in _grids(sketches(measured(documents))).collect()}
    common = rows.get("*")
    found = {}
    for language in (*LANGUAGES, "und"):
        own = rows.get(language)
        r = own if own is not None and own.n >= FEW else common
        if r is None:  # no document is ordinary: all are looked at
            found[language] = {s: (float("inf"), float("-inf")) for s in TAILS}
            continue
        found[language] = {}
        for s, (side, least) in TAILS.items():
            q10, q50, q90 = r[s][10], r[s][50], r[s][90]
            found[language][s] = (q50 - z * max(least, q50 - q10) if side <= 0 else float("-inf"), q50 + z * max(least, q90 - q50) if side >= 0 else float("inf"))
    return found


def _outside(values: tuple, limits: dict[str, tuple[float, float]]) -> list[str]:
    """Statistics that lie in a tail."""
    if values[1] is None:
        return []
    named = dict(zip(STATISTICS, values))
    return [s for s, (low, high) in limits.items() if not low <= named[s] <= high]


def tails(documents: DataFrame, z: float = Z) -> DataFrame:
    """The statistics of each row with each value's percentile and robust z-score in its language, and ``tail``, the statistics in a tail.

    Percentile grids are at most eight rows, so they are broadcast.  Null and
    blank texts have none.
    """
    stats = measured(documents)
    made = durable(sketches(stats))
    common = made.where("language = '*'").drop("language", "n")
    languages = made.sparkSession.createDataFrame([(x,) for x in (*LANGUAGES, "und")], "language string")
    enough = made.where((F.col("language") != "*") & (F.col("n") >= FEW))
    filled = languages.join(enough, "language", "left").join(common.select(*[F.col(s).alias(f"{s}_all") for s in STATISTICS]), F.lit(True), "left")
    grids = _grids(filled.select("language", "n", *[F.coalesce(s, f"{s}_all").alias(s) for s in STATISTICS]))
    out = stats.join(F.broadcast(grids.select("language", *[F.col(s).alias(f"{s}_q") for s in STATISTICS])), "language", "left")
    reasons = []
    for s in STATISTICS:
        value, q = F.col(s).cast("double"), F.col(f"{s}_q")

        def upto(q_, value=value):
            return q_ <= value

        out = out.withColumn(f"{s}_pct", F.when(value.isNotNull() & q.isNotNull(), F.size(F.filter(q, upto)) / 101))
        if s in TAILS:
            side, least = TAILS[s]
            q10, q50, q90 = (F.get(q, i) for i in (10, 50, 90))
            spread = F.when(value < q50, F.greatest(F.lit(least), q50 - q10)).otherwise(F.greatest(F.lit(least), q90 - q50))
            out = out.withColumn(f"{s}_z", (value - q50) / spread)
            far = (F.col(f"{s}_z") < -z) if side < 0 else (F.col(f"{s}_z") > z) if side > 0 else (F.abs(f"{s}_z") > z)
            reasons.append(F.when(F.coalesce(far, value.isNotNull() & q.isNull()), F.lit(s)))
    return out.withColumn("tail", F.array_compact(F.array(*reasons))).select("doc_id", "language", *STATISTICS, *[f"{s}_pct" for s in STATISTICS], *[f"{s}_z" for s in TAILS], "tail")


def _looked_at(documents: DataFrame, z: float) -> DataFrame:
    """(doc_id, tail, share) of the rows in a tail; the share is read from the text where the row is read, so no text is shuffled."""
    limits = bounds(documents, z)

    def each(rows):
        for doc_id, lang, text in rows:
            reasons = _outside(measure(text), limits[_language(lang)])
            if reasons:
                yield doc_id, reasons, readable_share(text)

    return map_rows(_read(documents), each, "doc_id long, tail array<string>, share double")


def found(documents: DataFrame, least: float = LEAST, z: float = Z) -> DataFrame:
    """doc_id of the documents in the tail of which less than ``least`` is readable."""
    return _looked_at(documents, z).where(F.col("share") < least).select("doc_id").distinct()


def reasons(documents: DataFrame, least: float = LEAST, z: float = Z) -> DataFrame:
    """(statistic, rows, found, alone): how many documents are in the tail of each statistic, how many of them less than ``least`` readable, and how many of those by this statistic alone."""
    rows = _looked_at(documents, z).select(F.explode("tail").alias("statistic"), (F.col("share") < least).alias("bad"), (F.size("tail") == 1).alias("one"))
    return rows.groupBy("statistic").agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("found"), F.count_if(F.col("bad") & F.col("one")).alias("alone"))
