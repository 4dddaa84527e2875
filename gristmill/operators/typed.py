"""Constructors of typed questions and decision rows, and their option orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import digest, once
from gristmill.functions.vectors import rotate

from .schema import DECISION

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter(i: Column) -> Column:
    return F.substring(F.lit(_LETTERS), i + 1, F.lit(1))


def choice(values: Column, correct: Column) -> tuple[Column, Column]:
    """Options lettered in the given order, and the gold letter; null where ``correct`` is no option."""
    options = F.transform(values, lambda v, i: F.struct(letter(i).alias("key"), v.cast("string").alias("text")))
    at = F.array_position(values, correct)
    return options, F.when(at > 0, letter((at - 1).cast("int")))


def noul(positive: Column) -> tuple[Column, Column]:
    """The binary question: false, then true."""
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(k).alias("text")) for k in ("false", "true")])
    return options, F.when(positive.isNotNull(), F.when(positive, "true").otherwise("false"))


def score(levels: Column, index: Column) -> tuple[Column, Column]:
    """Ordered levels keyed by their place."""
    options = F.transform(levels, lambda v, i: F.struct(i.cast("string").alias("key"), v.cast("string").alias("text")))
    return options, F.when((index >= 0) & (index < F.size(levels)), index.cast("string"))


def decision(**parts: Column | None) -> list[Column]:
    """The columns of a decision row; what is not given is null."""
    given = {k: v for k, v in parts.items() if v is not None}
    return [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in DECISION]


def option_keys(kind: Column, options: Column) -> Column:
    """Keys in answer order: as given for choice, false and true for noul, places for score."""
    return F.when(kind == "noul", F.array(F.lit("false"), F.lit("true"))).when(kind == "score", F.transform(options, lambda o, i: i.cast("string"))).otherwise(F.transform(options, lambda o: o["key"]))


def prefixed(options: Column) -> Column:
    """``key: text`` of each option; the key alone where the text is blank or the same."""
    return F.transform(options, lambda o: F.when(F.coalesce(F.trim(o["text"]), F.lit("")).isin("", o["key"]), o["key"]).otherwise(F.concat_ws(": ", o["key"], o["text"])))


def hash_order(values: Column, *salt: Column | str) -> Column:
    """Values by the digest of salt and value: a shuffle that any engine repeats."""
    keyed = F.transform(values, lambda v: F.struct(digest(*salt, v).alias("h"), v.alias("v")))
    return F.transform(F.sort_array(keyed), lambda s: s["v"])


def rotate_by_hash(values: Column, hashed: Column) -> Column:
    """Values rotated by a hash modulo their number."""
    return once(values, lambda v: once(F.pmod(hashed, F.greatest(F.size(v), F.lit(1)).cast("long")).cast("int"), lambda k: rotate(v, k)))


def all_rotations(df: DataFrame, values: str, out: str = "rotated", shift: str = "shift") -> DataFrame:
    """One row for each rotation of an array column."""
    turns = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn(shift, F.explode(turns)).withColumn(out, rotate(F.col(values), F.col(shift)))


def prompt(state: Column, instructions: Column, options: Column) -> Column:
    """Compact JSON of a question with options coded A to Z."""
    coded = F.map_from_arrays(F.transform(options, lambda o, i: letter(i)), F.transform(options, lambda o: F.coalesce(o["text"], o["key"])))
    return F.to_json(F.struct(state.alias("state"), instructions.alias("question"), coded.alias("options")))


def fingerprint(*parts: Column | str) -> Column:
    """Digest of the parts joined by a unit separator; null parts count as empty."""
    return digest(*[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts], sep="\x1f")


def assets(media: Column) -> Column:
    """One array of assets for a sequence, a single image or a video; empty without media."""
    single = F.array(F.struct(media["kind"].alias("kind"), media["path"].alias("path"), media["sha256"].alias("sha256"), F.lit(None).cast("string").alias("source_member")))
    empty = F.array().cast("array<struct<kind:string,path:string,sha256:string,source_member:string>>")
    return F.when(media.isNull(), empty).when(F.size(media["assets"]) > 0, media["assets"]).otherwise(single)


def messages(system: str, state: Column, instructions: Column, options: Column, assets: Column | None = None) -> Column:
    """A question as chat messages: a system turn, and a user turn of one mark for each asset, the state, the question
    and its options coded A to Z, one a line."""
    coded = F.array_join(F.transform(options, lambda o, i: F.concat_ws(". ", letter(i), F.coalesce(o["text"], o["key"]))), "\n")
    marks = F.lit(None).cast("string") if assets is None else F.nullif(F.array_join(F.transform(assets, lambda a: F.concat(F.lit("<"), a["kind"], F.lit(">"))), "\n"), F.lit(""))
    user = F.concat_ws("\n", marks, F.nullif(state, F.lit("")), instructions, coded)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user))
