"""Sentence boundaries learned from the corpus itself, without a list of abbreviations.

One pass over the texts counts contexts: how often a word type stands after what kind of token, in which
case, with or without a point. Words are counted as they are written; their columns are made of the counted
ones, which are far fewer than the texts' words. All that is learned comes from this one table:

* abbreviations: types whose points are too frequent to be sentence ends, by a log-likelihood ratio that is
  scaled down for long types and for those seen without a point, and up for points inside;
* spelling: whether a type is seen in lower case, or in upper case inside sentences;
* collocations: pairs that stand around a point more often than chance has it;
* starters: types that follow sentence ends more often than chance has it.

A text is then cut at every token that can end a sentence. Most do; abbreviations, ellipses, initials and
numbers are looked at again, by the word that follows, and where the sentence goes on the parts are put
together. Decisions are joins of these few tokens with the learned tables, so that tables of any
size are shuffled or broadcast as Spark sees fit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop, written

# Fixed values of the published method: the least scores, and the probability of a point after an abbreviation.
ABBREVIATION, COLLOCATION, STARTER, POINTED = 0.3, 7.88, 30.0, 0.99

#: A token is a run of other than white space; with what follows it, so that pieces add up to the text.
PIECE = r"[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*"
WORD = r"[^ \t\n\x0B\f\r]+"
#: A number, for SQL; and as two patterns, of which the second mustn't match, that need no stack for a number of many parts.
NUMBER = r"^[-+]?[0-9]+([.,][0-9]+)*$"
DIGITS, DOUBLED = r"^[-+]?[0-9](?:[0-9.,]*[0-9])?\z", r"[.,][.,]"
#: What may stand before and after a token; of the latter, signs that go on with the sentence.
OPENING, CLOSING, GOING_ON = "\"'([{«“‘„¿¡", "\"')]}»”’", ",;:"
#: OPENING and CLOSING as a pattern, for SQL.
EDGES = r"""^["'(\[{«“‘„¿¡]+|["')\]}»”’,;:]+$"""
#: As few pieces as end with one whose Token.end is ".", ".." or "!"; then what is left. Without nested repeats, so that
#: long texts need neither stack nor a second look.
PART = r"""(?s)[^.!?]*+.*?[.!?]["')\]}»”’]*+(?:[ \t\n\x0B\f\r]++|\z)|(?s).+"""
#: The last token of a part, in group 1.
LAST = r"(?s)^(?:.*[ \t\n\x0B\f\r])?([^ \t\n\x0B\f\r]+)[ \t\n\x0B\f\r]*\z"

#: What `strip` leaves of a text, in group 1; unlike its pattern this one doesn't stop at the white space within.
STRIPPED = r"(?sU)^[\s\x1c-\x1f]*+(.*[^\s\x1c-\x1f])?"


def parts(text: Column) -> Column:
    """A text cut after every token that can end a sentence; white space of a whole text is a part."""
    return F.regexp_extract_all(text, F.lit(PART), F.lit(0))


@dataclass
class Token:
    """Columns of a token, of plain string functions. end: "," where the sentence goes on, "!" for an end mark, ".." for
    an ellipsis, "." for a point, else empty."""

    core: Column
    tail: Column

    @classmethod
    def of(cls, word: Column) -> Token:
        return cls(F.ltrim(F.rtrim(word, F.lit(CLOSING + GOING_ON)), F.lit(OPENING)), F.rtrim(word, F.lit(CLOSING)))

    @classmethod
    def held(cls, core: str, tail: str) -> Token:
        """Of columns that were selected before, so that no branch trims a token again."""
        return cls(F.col(core), F.col(tail))

    @property
    def type(self) -> Column:
        bare = F.lower(F.rtrim(self.core, F.lit(".!?")))
        number = F.substring(bare, 1, 1).isin(*"0123456789+-") & bare.rlike(DIGITS) & ~bare.rlike(DOUBLED)
        return F.when(number, "#").otherwise(bare)

    @property
    def point(self) -> Column:
        return F.endswith(self.core, F.lit(".")) & ~F.endswith(self.core, F.lit(".."))

    @property
    def end(self) -> Column:
        goes_on = F.right(self.tail, F.lit(1)).isin(*GOING_ON)
        return F.when(goes_on, ",").when(F.right(self.core, F.lit(1)).isin("!", "?"), "!").when(F.endswith(self.core, F.lit("..")), "..").when(F.endswith(self.core, F.lit(".")), ".").otherwise("")

    @property
    def case(self) -> Column:
        first = F.substring(self.core, 1, 1)
        return F.when(first != F.lower(first), "upper").when(first != F.upper(first), "lower").otherwise("none")


def contexts(df: DataFrame, text: str = "text", group: str | None = None) -> DataFrame:
    """group, type, point, case, before (how the token before ends; start at the beginning of a text), after (the
    type of the token before if that has a point), n. The group keeps languages apart; one pass, one aggregate, by
    the words as written: a context has a row for each of its spellings."""
    held = F.col(group) if group else F.lit(None).cast("string")
    rows = df.where(F.col(text).isNotNull()).select(held.cast("string").alias("group"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("p"))
    last = F.slice(F.concat(F.array(F.lit(None).cast("string")), "p"), F.lit(1), F.size("p"))
    # exploded first, so that the columns of a token are compiled code; a filter on p would find the words once more
    each = rows.select("group", F.explode(F.arrays_zip(F.col("p").alias("x"), last.alias("y"))).alias("z")).select("group", F.col("z.x").alias("x"), F.col("z.y").alias("y"))
    # a token without these signs has neither an end nor a point
    signs, y = reduce(or_, [F.contains("y", F.lit(c)) for c in GOING_ON + ".!?"]), Token.of(F.col("y"))
    each = each.select("group", "x", F.col("y").isNull().alias("start"), F.when(signs, y.core).alias("core"), F.when(signs, y.tail).alias("tail"))
    y = Token.held("core", "tail")
    before = F.when(F.col("start"), "start").when(F.col("core").isNull(), "").otherwise(y.end)
    each = each.select("group", "x", before.alias("before"), F.when(y.point, y.type).alias("after"))
    counted, x = each.groupBy(*each.columns).agg(F.count("*").alias("n")), Token.of(F.col("x"))
    counted, x = counted.select("*", x.core.alias("core"), x.tail.alias("tail")), Token.held("core", "tail")
    return counted.select("group", x.type.alias("type"), x.point.alias("point"), x.case.alias("case"), "before", "after", "n")


def _binomial(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n at probability p, with 0 log 0 = 0."""
    part = lambda c, q: F.when(c <= 0, 0.0).when(q <= 0, -1e9).otherwise(c * F.ln(q))
    return part(k, p) + part(n - k, 1 - p)


def types(contexts: DataFrame) -> DataFrame:
    """group, type, n, pointed, score, abbreviation of the types seen with a point."""
    by = contexts.groupBy("group", "type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("point"), F.col("n")).otherwise(0)).alias("pointed"))
    all_ = by.groupBy(F.col("group").alias("__g")).agg(F.sum("n").alias("tokens"), F.sum("pointed").alias("points"))
    rows = by.where("pointed > 0").join(all_, F.col("group").eqNullSafe(F.col("__g")))
    n, k = F.col("n").cast("double"), F.col("pointed").cast("double")
    ratio = 2 * (_binomial(k, n, F.lit(POINTED)) - _binomial(k, n, F.col("points") / F.col("tokens")))
    inside = F.char_length("type") - F.char_length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.char_length("type") - inside).cast("double")
    score = ratio * F.exp(-letters) * (inside + 1) * F.pow(letters, -(n - k))
    known = F.col("type").rlike(r"\p{L}")
    rows = rows.withColumn("score", F.when(known, score).otherwise(0.0))
    return rows.select("group", "type", "n", "pointed", "score", (F.col("score") >= ABBREVIATION).alias("abbreviation"))


def _association(c1: Column, c2: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events that meet `both` times, 0 where they meet less than by chance."""
    p, p1, p2 = c2 / n, both / c1, F.try_divide(c2 - both, n - c1)
    p2 = F.coalesce(p2, F.lit(0.0))
    ratio = 2 * (_binomial(both, c1, p1) + _binomial(c2 - both, n - c1, p2) - _binomial(both, c1, p) - _binomial(c2 - both, n - c1, p))
    return F.when(p1 > p, ratio).otherwise(0.0)


def _initial(c: Column) -> Column:
    return c.rlike(r"^\p{L}\z")


@dataclass
class Punkt:
    """What was learned, as written tables: abbreviations, spelling, collocations, starters."""

    abbreviations: DataFrame
    spelling: DataFrame
    collocations: DataFrame
    starters: DataFrame

    def drop(self) -> None:
        drop(self.abbreviations, self.spelling, self.collocations, self.starters)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def learned(df: DataFrame, text: str = "text", group: str | None = None) -> Punkt:
    """Learns from the texts of df; null texts are left out, a null group is a group of its own."""
    table = written(contexts(df, text, group), "contexts")
    abbreviations = written(types(table).where("abbreviation").select(F.col("group").alias("a_group"), F.col("type").alias("a_type")), "abbreviations")
    rows = table.join(abbreviations, _same("group", "a_group") & (F.col("after") == F.col("a_type")), "left")
    # what the token before is, after the first pass
    weak = (F.col("before") == "..") | ((F.col("before") == ".") & (F.col("a_type").isNotNull() | _initial(F.col("after")) | (F.col("after") == "#")))
    broke = F.col("before").isin("start", "!") | ((F.col("before") == ".") & F.col("a_type").isNull())
    rows = rows.withColumn("place", F.when(weak, "open").when(broke, "first").otherwise("inside"))
    count = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0))
    by = rows.groupBy("group", "type").agg(
        F.sum("n").alias("n"),
        count(F.col("case") == "lower").alias("lower"),
        count((F.col("case") == "lower") & (F.col("place") == "first")).alias("lower_first"),
        count(F.col("case") == "upper").alias("upper"),
        count((F.col("case") == "upper") & (F.col("place") == "inside")).alias("upper_inside"),
        count((F.col("place") == "first") & (F.col("before") != "start")).alias("after_break"),
    )
    spelling = written(by.select(F.col("group").alias("s_group"), F.col("type").alias("s_type"), "n", "lower", "lower_first", "upper", "upper_inside", "after_break"), "spelling")
    total = spelling.groupBy(F.col("s_group").alias("t_group")).agg(F.sum("n").alias("tokens"), F.sum("after_break").alias("breaks"))
    d = lambda c: F.col(c).cast("double")
    start = spelling.where(F.col("s_type").rlike(r"^\p{L}") & (F.col("after_break") > 0)).join(total, _same("s_group", "t_group"))
    starters = start.where(_association(d("breaks"), d("n"), d("after_break"), d("tokens")) >= STARTER).select(F.col("s_group").alias("b_group"), F.col("s_type").alias("b_type"))
    pairs = rows.where((F.col("before") == ".") & (F.col("place") == "open") & F.col("type").rlike(r"^\p{L}")).groupBy("group", "after", "type").agg(F.sum("n").alias("both"))
    one = spelling.select(F.col("s_group").alias("g1"), F.col("s_type").alias("w1"), F.col("n").alias("n1"))
    two = spelling.select(F.col("s_group").alias("g2"), F.col("s_type").alias("w2"), F.col("n").alias("n2"))
    pairs = pairs.join(one, _same("group", "g1") & (F.col("after") == F.col("w1"))).join(two, _same("group", "g2") & (F.col("type") == F.col("w2"))).join(total, _same("group", "t_group"))
    found = pairs.where(_association(d("n1"), d("n2"), d("both"), d("tokens")) >= COLLOCATION)
    collocations = found.select(F.col("group").alias("c_group"), F.col("after").alias("c_one"), F.col("type").alias("c_two"))
    out = Punkt(abbreviations, spelling, written(collocations, "collocations"), written(starters, "starters"))
    drop(table)
    return out


def continued(df: DataFrame, model: Punkt, key: str, text: str = "text", group: str | None = None) -> DataFrame:
    """key, mark (a hash of the text), on: the numbers, from 1, of the parts after which the sentence goes on. Only last
    tokens with a point leave their row, for the joins; rows whose parts all are sentences aren't among the results."""
    held = F.col(group) if group else F.lit(None).cast("string")
    rows = df.where(F.contains(F.col(text), F.lit("."))).select(F.col(key), F.xxhash64(F.col(text)).alias("mark"), held.cast("string").alias("group"), parts(F.col(text)).alias("p"))
    # found before they are exploded, as a filter would find them once more
    last = F.transform(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), lambda c: F.regexp_extract(c, LAST, 1))
    following = F.transform(F.slice("p", 2, 1 << 30), lambda c: F.regexp_extract(c, WORD, 0))
    each = rows.select(key, "mark", "group", F.posexplode(F.arrays_zip(last.alias("x"), following.alias("y"))).alias("at", "z"))
    x, y = Token.of(F.col("z.x")), Token.of(F.col("y"))
    each = each.where(F.endswith(x.tail, F.lit("."))).select(key, "mark", "group", (F.col("at") + 1).alias("at"), x.core.alias("core"), x.tail.alias("tail"), F.col("z.y").alias("y"))
    x = Token.held("core", "tail")
    each = each.select(key, "mark", "group", "at", x.end.alias("end"), x.type.alias("type"), "y")
    m = model
    each = each.join(m.abbreviations, _same("group", "a_group") & (F.col("type") == F.col("a_type")) & (F.col("end") == "."), "left")
    short = F.col("a_type").isNotNull()
    initial, number = _initial(F.col("type")), F.col("type") == "#"
    hard = each.where((F.col("end") == "..") | short | initial | number).select("*", y.type.alias("next"), y.case.alias("case")).drop("y")
    hard = hard.join(m.spelling, _same("group", "s_group") & (F.col("next") == F.col("s_type")), "left")
    hard = hard.join(m.collocations, _same("group", "c_group") & (F.col("type") == F.col("c_one")) & (F.col("next") == F.col("c_two")), "left")
    hard = hard.join(m.starters, _same("group", "b_group") & (F.col("next") == F.col("b_type")), "left")
    seen = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    upper, lower = F.col("case") == "upper", F.col("case") == "lower"
    spelled = F.when(upper & seen("lower") & ~seen("upper_inside"), True).when(lower & (seen("upper") | ~seen("lower_first")), False)
    never = upper & ~seen("lower")
    ends = (
        F.when(F.col("c_one").isNotNull(), False)
        .when((short | (F.col("end") == "..")) & ~initial, F.coalesce(spelled, upper & F.col("b_type").isNotNull()))
        .when(spelled.isNotNull() & (~spelled | initial), spelled)
        .when(initial & never, False)
        .otherwise(~short)
    )
    return hard.where(~ends).groupBy(key, "mark").agg(F.array_sort(F.collect_set("at")).alias("on"))


def split_sentences(df: DataFrame, model: Punkt, key: str, text: str = "text", group: str | None = None, out: str = "sentences") -> DataFrame:
    """df with the sentences of its texts: their pieces joined and stripped, null for null texts, none for texts
    of white space alone. key needs not be unique: rows that share it and their text share the result."""
    found = continued(df, model, key, text, group).select(F.col(key).alias("__key"), F.col("mark").alias("__mark"), F.col("on").alias("__on"))
    # texts are shuffled whole, and cut after that
    rows = df.drop(out).join(found, F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text)) == F.col("__mark")), "left").withColumn("__parts", parts(F.col(text)))
    ends = F.array_except(F.sequence(F.lit(1), F.size("__parts")), "__on")
    starts = F.concat(F.array(F.lit(0)), F.slice("__ends", 1, F.size("__ends") - 1))
    joined = F.transform(F.arrays_zip(starts.alias("a"), F.col("__ends").alias("b")), lambda z: F.array_join(F.slice("__parts", z["a"] + 1, z["b"] - z["a"]), ""))
    rows = rows.withColumn("__ends", F.when(F.col("__on").isNotNull(), ends))
    cut = F.transform(F.when(F.col("__ends").isNull(), F.col("__parts")).otherwise(joined), lambda s: F.regexp_extract(s, STRIPPED, 1))
    return rows.withColumn(out, F.when(F.col(text).isNotNull(), F.filter(cut, lambda s: s != ""))).select(*df.drop(out).columns, out)
