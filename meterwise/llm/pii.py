"""Personal data: exact patterns, and terms that disclose a protected entity.

The second part follows information-theoretic sanitisation. With N documents, an entity c (a
matched value) has the information IC(c) = -log2 p(c). A term t that stands in documents of c
leaves IC(c|t) = -log2 p(c|t) of it, so it discloses the share 1 - IC(c|t) / IC(c). Terms that
disclose much are removed, terms that disclose less are generalised. A value that is too rare to
be rated itself is rated as its class, the kind of value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.native import chunks, cut, let, sums_before
from meterwise.llm.storage import hand_over, row_key

KINDS = ("email", "ip", "card", "phone")
ADDED = ("removed", "generalised")
#: The specified patterns in possessive form: same matches, without backtracking or recursion.
#: ``\G`` lets an address begin where the one before ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of a kind holds: texts without it are not searched.
_SIGNS = {"email": "@", "ip": ".", "phone": "+"}
WINDOW = 64
MIN_CONTEXTS = 3
REMOVE_AT = 0.9
GENERALISE_AT = 0.75
#: Documents at the class's own share that are added to what a term was seen with.
PRIOR = 3
#: A term is a run of three letters or more between white space, but for punctuation around it.
_TERM = r"(?<=[\s(\"'])\p{L}[\p{L}\p{M}'’-]{2,}+(?=[,.;:!?)\"']{0,3}\s)"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, F.lit(r"\.")),
            lambda x: F.coalesce(F.regexp_replace(x, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)),
        )
    digits = F.length(_digits(value))
    if kind == "card":
        return digits.between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return digits.between(10, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """The value that counts as the same entity, however it is written."""
    return F.lower(value) if kind in ("email", "ip") else _digits(value)


def _found(text: Column, kind: str) -> Column:
    """All raw matches of a kind (a) and the texts before each (b)."""
    pattern = F.lit(PATTERNS[kind])
    matches, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, F.lit(-1))
    if kind in _SIGNS:
        found = F.contains(text, F.lit(_SIGNS[kind]))
        none = F.array().cast("array<string>")
        matches, between = F.when(found, matches).otherwise(none), F.when(found, between).otherwise(none)
    return F.struct(matches.alias("a"), between.alias("b"))


def _kind_spans(text: Column, place: int, kind: str) -> Column:
    """Valid spans of a kind: (start, place, end, kind, entity)."""

    def span(pair: Column, before: Column) -> Column:
        start = before + F.length(pair["y"])
        return F.struct(
            start.alias("start"), F.lit(place).alias("place"), (start + F.length(pair["x"])).alias("end"),
            F.lit(kind).alias("kind"),
            F.when(_valid(kind, pair["x"]), _entity(kind, pair["x"])).alias("entity"),
        )

    def spans(pairs: Column) -> Column:
        steps = F.transform(pairs, lambda p: F.length(p["x"]) + F.length(p["y"]))
        return F.filter(F.zip_with(pairs, sums_before(steps), span), lambda s: s["entity"].isNotNull())

    def pairs(e: Column) -> Column:
        before = F.slice(e["b"], F.lit(1), F.size(e["a"]))
        return F.zip_with(e["a"], before, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    return let(_found(text, kind), lambda e: let(pairs(e), spans))


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``base``: an array of (start, place, end, kind, entity), sorted.

    Matches of a kind are leftmost and do not overlap. Their starts follow from the lengths of
    the matches and of the pieces between them, in code points.
    """
    found = [_kind_spans(F.col(text_col), k, kind) for k, kind in enumerate(KINDS)]
    return docs.withColumn("base", F.sort_array(F.concat(*found)))


def _padded(text: Column) -> Column:
    """One space on either side stands for the edge of the text; places shift by one."""
    return F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_padded(text), F.lit(_TERM), F.lit(0)), F.lower))


def _term_places(text: Column, wanted: Column) -> Column:
    """All occurrences of the ``wanted`` terms, a map from term to place: (start, place, end)."""
    pattern = F.lit(_TERM)

    def pairs(e: Column) -> Column:
        before = F.slice(e["b"], F.lit(1), F.size(e["a"]))
        return F.zip_with(e["a"], before, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def spans(p: Column) -> Column:
        steps = F.transform(p, lambda s: F.length(s["x"]) + F.length(s["y"]))
        every = F.zip_with(
            p, sums_before(steps),
            lambda s, at: F.struct(
                (at + F.length(s["y"]) - 1).alias("start"),
                F.element_at(wanted, F.lower(s["x"])).alias("place"),
                (at + F.length(s["y"]) + F.length(s["x"]) - 1).alias("end"),
            ),
        )
        return F.filter(every, lambda s: s["place"].isNotNull())

    padded = _padded(text)
    found = F.struct(
        F.regexp_extract_all(padded, pattern, F.lit(0)).alias("a"), F.split(padded, pattern, F.lit(-1)).alias("b")
    )
    return let(found, lambda e: let(pairs(e), spans))


def _first_of_each(items: Column, fields: tuple[str, ...]) -> Column:
    """The least struct of each group of ``fields``, which lead the structs."""

    def new(s: Column, x: Column, i: Column) -> Column:
        before = F.get(s, i - 1)
        same = [before[f].eqNullSafe(x[f]) for f in fields]
        return (i == 0) | ~(same[0] if len(same) == 1 else same[0] & same[1])

    return let(F.sort_array(items), lambda s: F.filter(s, lambda x, i: new(s, x, i)))


def protected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, key, ``base`` spans, ``units`` and ``terms``.

    ``units`` are what the document protects, (kind, entity, context): every value once, and
    every kind once as its class, with a null entity. The context is a hash of the ``WINDOW``
    code points before and after a value, the least one if there are several. ``terms`` are the
    distinct terms of the whole text; documents without a value have none.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    found = base_spans(rows, "text")

    def unit(s: Column, e: Column) -> Column:
        left = F.greatest(s["start"] - WINDOW, F.lit(0))
        right = F.least(s["end"] + WINDOW, e["long"])
        return F.struct(
            s["kind"].alias("kind"), s["entity"].alias("entity"),
            F.xxhash64(
                cut(e["pieces"], left, s["start"] - left), cut(e["pieces"], s["end"], right - s["end"])
            ).alias("context"),
        )

    whole = F.struct(chunks(F.col("text")).alias("pieces"), F.length("text").alias("long"))
    values = let(whole, lambda e: F.transform("base", lambda s: unit(s, e)))

    def units(v: Column) -> Column:
        kinds = F.transform(
            v, lambda x: F.struct(x["kind"].alias("kind"), F.lit(None).cast("string").alias("entity"), x["context"].alias("context"))
        )
        return F.concat(_first_of_each(v, ("kind", "entity")), _first_of_each(kinds, ("kind",)))

    every, terms = let(values, units), _terms(F.col("text"))
    some = F.size("base") > 0
    found = found.withColumn("units", F.when(some, every).otherwise(F.array().cast(found.select(every).schema[0].dataType)))
    return found.withColumn("terms", F.when(some, terms).otherwise(F.array().cast("array<string>"))).drop("text")


_UNIT = ["kind", "entity"]


def _counted(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Documents and different contexts per ``by``; rows that agree are summed where they are read."""
    parts = df.groupBy(*by, "context").agg(F.count("*").alias(name))
    return parts.groupBy(*by).agg(F.sum(name).alias(name), F.count("*").alias("contexts"))


def _same_unit(left: str, right: str) -> Column:
    return (F.col(f"{left}.kind") == F.col(f"{right}.kind")) & F.col(f"{left}.entity").eqNullSafe(F.col(f"{right}.entity"))


def units_of(found: DataFrame, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """``(kind, entity, with_entity)`` of all values and classes seen in ``min_contexts`` different contexts."""
    every = found.select(F.inline("units"))
    return _counted(every, _UNIT, "with_entity").where(F.col("contexts") >= min_contexts).drop("contexts")


def disclosures(found: DataFrame, docs: DataFrame, text_col: str, units: DataFrame,
                min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """``(kind, entity, term, disclosure)`` of all pairs of a unit and a term of its documents
    that were seen in ``min_contexts`` different contexts.

    p(c) and p(c|t) are shares of documents: those that hold c, and of those that hold t, those
    that hold both, wherever. All counts are of rows and cover whole texts. Copies of a context
    count as documents, but not as contexts, so that a text that was copied often proves no more
    than one. A class (null entity) is common, so terms share its documents by chance as well:
    its p(c|t) counts ``PRIOR`` more documents at the class's own share.
    """
    n = max(1, found.count())
    held = found.where(F.size("units") > 0).select("terms", F.explode("units").alias("u")).select("terms", "u.*")
    held = held.alias("h").join(units.alias("u"), _same_unit("h", "u"), "left_semi")
    pairs = held.select("kind", "entity", "context", F.explode("terms").alias("term"))
    near = _counted(pairs, [*_UNIT, "term"], "joint").where(F.col("contexts") >= min_contexts)
    near = hand_over(near.drop("contexts"), "near")
    words = docs.select(F.explode(_terms(F.col(text_col))).alias("term"))
    words = words.join(hand_over(near.select("term").distinct(), "near-terms"), "term", "left_semi")
    terms = hand_over(words.groupBy("term").agg(F.count("*").alias("with_term")), "terms")
    rated = near.alias("p").join(units.alias("u"), _same_unit("p", "u")).select(
        "p.*", "u.with_entity").join(terms, "term")
    share = F.col("with_entity") / F.lit(n)
    prior = F.when(F.col("entity").isNull(), PRIOR).otherwise(0)
    known = -F.log2(share)
    left = -F.log2((F.col("joint") + prior * share) / (F.col("with_term") + prior))
    return rated.withColumn("disclosure", F.when(known > 0, 1 - left / known)).select(*_UNIT, "term", "disclosure")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT,
         min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """``(id, key, base, added)``, one row per document.

    ``base`` has the patterns' spans (start, place, end, kind, entity), ``added`` all occurrences
    of the terms that disclose a value of the document, as (start, place, end, kind) with kind
    ``removed`` or ``generalised``; both are sorted and count code points, ends exclusive. A
    value in fewer than ``min_contexts`` different contexts is protected as its class.

    Null and empty texts have no spans. Null ids are carried through; repeated rows are returned
    as often as they occur and every one counts in all statistics. An entity that
    every document holds has nothing to disclose. Other columns are not read. An empty table
    gives an empty one.

    The tables that are joined are handed over, so Spark knows their bytes: it broadcasts those
    below ``spark.sql.autoBroadcastJoinThreshold`` and joins the others by key.
    """
    found = hand_over(protected(docs, id_col, text_col), "protected")
    units = hand_over(units_of(found, min_contexts), "units")
    rated = disclosures(found, docs, text_col, units, min_contexts)
    telling = hand_over(
        rated.where(F.col("disclosure") >= generalise_at).select(
            *_UNIT, "term", (F.lit(len(KINDS)) + (F.col("disclosure") < remove_at).cast("int")).alias("place")
        ),
        "telling",
    )
    # What a document protects: its values, or the class where a value could not be rated.
    held = found.where(F.size("units") > 0).select("key", "terms", F.explode("units").alias("u"))
    held = held.select("key", "terms", "u.kind", "u.entity").where("entity IS NOT NULL")
    own = units.where("entity IS NOT NULL").select(*_UNIT, F.lit(True).alias("own"))
    held = held.join(own, _UNIT, "left").select(
        "key", "terms", "kind", F.when(F.col("own"), F.col("entity")).alias("entity")
    ).distinct()
    wanted = (
        held.select("key", *_UNIT, F.explode("terms").alias("term")).alias("h")
        .join(telling.alias("t"), _same_unit("h", "t") & (F.col("h.term") == F.col("t.term")))
        .groupBy("h.key", "h.term").agg(F.min("t.place").alias("place"))
        .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "place"))).alias("wanted"))
    )
    wanted = hand_over(wanted, "wanted")
    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, "key").dropDuplicates(["key"])
    added = texts.select(
        "key",
        F.transform(
            _term_places(F.col("text"), F.col("wanted")),
            lambda s: F.struct(
                s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end"),
                F.when(s["place"] == len(KINDS), ADDED[0]).otherwise(ADDED[1]).alias("kind"),
            ),
        ).alias("added"),
    )
    added = hand_over(added, "added")
    return found.select("id", "key", "base").join(added, "key", "left").select(
        "id", "key", "base",
        F.coalesce("added", F.array().cast(added.schema["added"].dataType)).alias("added"),
    )


def described(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``sanitised``: matched values and disclosing terms replaced.

    Values become ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``, removed terms vanish, others
    are generalised to ``[NAME]`` if capitalised and ``[TERM]`` if not. Where spans overlap, the
    one that begins first is replaced and the others' rest with it. A null text stays null.
    """
    found = find(docs, id_col, text_col, **options)
    spans = found.groupBy("key").agg(F.first("base").alias("__base"), F.first("added").alias("__added"))
    rows = docs.withColumn("__key", row_key(id_col, text_col)).join(
        spans.withColumnRenamed("key", "__key"), "__key", "left"
    )
    every = F.sort_array(
        F.concat(
            F.transform("__base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
            F.transform("__added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
        )
    )
    kept = F.col(text_col)
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("out"))

    def replaced(pieces: Column) -> Column:
        # The text up to each span, from where the spans before it ended, then its replacement.
        def step(a: Column, s: Column) -> Column:
            gap = cut(pieces, a["end"], F.greatest(s["start"], a["end"]) - a["end"])
            first = cut(pieces, s["start"], F.lit(1))
            general = F.when(F.lower(first) != first, "[NAME]").otherwise("[TERM]")
            mark = (
                F.when((s["start"] < a["end"]) | (s["kind"] == ADDED[0]), "")
                .when(s["kind"] == ADDED[1], general)
                .otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            )
            return F.struct(
                F.greatest(a["end"], s["end"]).alias("end"), F.concat(a["out"], F.array(gap, mark)).alias("out")
            )

        done = F.aggregate("__spans", start, step)
        return let(
            done,
            lambda d: F.concat(F.array_join(d["out"], ""), cut(pieces, d["end"], F.length(kept) - d["end"])),
        )

    rows = rows.withColumn("__spans", every)
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns], let(chunks(kept), replaced).alias("sanitised")
    )
