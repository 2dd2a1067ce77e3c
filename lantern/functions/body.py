"""Bodies of messages: charsets, header tables, part trees, and the class of each line. Nothing is ever removed from a text."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

# Bounds of part trees, the order of charsets, bounds of attributions and signatures.
MAX_DEPTH, MAX_PARTS = 12, 64
CHARSETS = ("utf-8", "cp1252", "latin-1")
ATTRIBUTION_CHARS, SIGNATURE_LINES, SIGNATURE_CHARS = 300, 6, 60

# The verbs of attribution lines by language, their first words, and weekday names with abbreviations.
VERBS = r"wrote|a\s+écrit|escribió|escribio|escreveu|schrieb|ha\s+scritto|schreef|napisał[ay]?|skrev|kirjoitti"
OPENERS = r"on|le|am|op|il\s+giorno|w\s+dniu|den|el|em|(?:ma|ti|ke|to|pe|la|su)(?=\s+\d)"
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lun mar mer jeu ven sam dim "
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so "
    "lunes martes miércoles miercoles jueves viernes sábado sabado domingo mié mie jue vie sáb sab dom "
    "segunda terça terca quarta quinta sexta seg ter qua qui sex "
    "lunedì lunedi martedì martedi mercoledì mercoledi giovedì giovedi venerdì venerdi sabato domenica gio "
    "maandag dinsdag woensdag donderdag vrijdag zaterdag zondag ma wo vr za zo "
    "poniedziałek wtorek środa czwartek piątek sobota niedziela pon wt śr czw pt sob niedz "
    "måndag tisdag onsdag torsdag fredag lördag söndag mandag tirsdag lørdag søndag mån tis ons tors tor fre lör sön man tir lør søn "
    "maanantai tiistai keskiviikko torstai perjantai lauantai sunnuntai ti ke pe la su"
).split()
# Pronouns of the first person; an attribution names somebody else.
FIRST_PERSON = (
    "i me my mine we us our ours je j' moi mon ma mes nous notre nos ich mich mir mein meine wir uns unser yo mi mis nosotros nuestro "
    "eu meu minha nós nosso io mio mia noi nostro ik mij mijn wij ons onze ja mnie mój moje my nasz jag mig min mitt vi oss jeg minä minun meidän"
).split()
# Formats of addresses and dates, separators, header fields, sign-offs.
ADDRESS = r"(?:<[^<>@\s]{1,64}@[^<>\s]{1,255}>|\(?\b[\w.!#$%&'*+/=?^`{|}~-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}\b\)?)"
DATE = (
    r"(?:\b\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*(?:19|20)?\d{2}\b|\b\d{1,2}\s+de\s+[^\W\d_]{2,12}\.?\s+de\s+(?:19|20)\d{2}\b"
    r"|\b\d{1,2}\.?\s+[^\W\d_]{2,12}\.?,?\s+(?:19|20)\d{2}\b|\b[^\W\d_]{2,12}\.?\s+\d{1,2},?\s+(?:19|20)\d{2}\b)"
)
SEPARATOR = r"^\s*(?:[-_*]{2,}\s*)?(?:original message|forwarded message|begin forwarded message)\s*(?:[-_*]{2,})?\s*:?\s*$"
HEADER = r"^\s*(from|sent|to|cc|bcc|subject|date|reply-to)\s*:\s*\S"
MARK = r"^\s*>"
DELIMITER = r"^\s*(?:--|__)\s*$"
SIGN_OFF = (
    r"^\s*(?:(?:best regards|kind regards|warm regards|with regards|best wishes|all the best|many thanks|thanks again|thanks in advance|thank you|thanks|cheers|regards|best|"
    r"sincerely|yours sincerely|yours truly|yours faithfully|respectfully)\s*[,.!]?|sent from my \S.*|sent from \S+ mail.*|get outlook for \S+.*)\s*$"
)
#: Unicode classes, any case, and only \n ends a line.
FLAGS = "(?iUd)"
CLASS_OF = {
    "quote_marker": "quoted", "header_block": "quoted", "client_attribution": "quoted", "forward_separator": "forwarded",
    "signature_delimiter": "signature", "signature_sign_off": "signature", "forward_separator_unmarked_extent": "uncertain",
    "header_block_unmarked_extent": "uncertain", "client_attribution_unmarked_extent": "uncertain",
}


# --- Lines ---------------------------------------------------------------------


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def attribution(line: Column) -> Column:
    """The format of attribution line that a line is in whole, or null: an address is wanted, and nobody who says I."""
    c = stripped(line)
    near = rf"(?:(?<![\w'’])(?:{'|'.join(sorted(set(WEEKDAYS), key=len, reverse=True))})\.?\s*,?\s*)?"
    # Weekdays are pronouns in other languages: the date goes before pronouns are looked for.
    undated = F.regexp_replace(c, rf"{FLAGS}^(.*?){near}{DATE}", "$1 ")
    says_i = undated.rlike(rf"{FLAGS}(?<![\w'’])(?:{'|'.join(FIRST_PERSON)})(?![\w'’])")
    opens = rf"{FLAGS}^(?:{OPENERS})\b.{{0,160}}{DATE}.{{0,120}}"
    bare = rf"{FLAGS}^(.{{0,60}}?)\s*{ADDRESS}\s*\b(?:{VERBS})\s*:\s*$"
    name = F.regexp_replace(F.regexp_extract(c, bare, 1), r"""(?U)^[\s"']+|[\s"']+$""", "")
    is_name = (name == "") | name.rlike(r"(?U)^[^\p{L}\s]*\p{Lu}\S*(?:\s+[^\p{L}\s]*\p{Lu}\S*){0,3}$")
    found = (
        F.when(c.rlike(rf"{opens}{ADDRESS}.{{0,60}}\b(?:{VERBS})\s*:\s*$"), "lead_in_date_address_verb")
        .when(c.rlike(rf"{opens}\b(?:{VERBS})\s+[^<>:]{{0,60}}{ADDRESS}\s*:\s*$"), "lead_in_date_verb_sender_address")
        .when(c.rlike(bare) & is_name, "display_name_address_verb")
    )
    return F.when((F.length(c) <= ATTRIBUTION_CHARS) & c.endswith(":") & ~says_i, found)


def looks_quoted(c: Column) -> Column:
    """Whether a fragment has the shape of an earlier message: a separator, an attribution, a mark, or two header fields."""
    fields = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?imUd)^\s*(from|sent|to|cc|bcc|subject|date|reply-to)\s*:\s*\S"), F.lit(1)), F.lower))
    return c.rlike("(?m)" + FLAGS + SEPARATOR) | c.rlike(rf"(?m){FLAGS}^.{{0,200}}\b(?:{VERBS})\s*:\s*$") | c.rlike("(?m)" + FLAGS + MARK) | (F.size(fields) >= 2)


def lines(bodies: DataFrame, id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    """id, line, text, last, class, signal for each line of each body; ids have to be unique, a null text has no line.

    What clients write is seen first (separators, header blocks, marks, attributions), then what lies below it without
    marks, then signatures in what is left. All by windows over one body, in both directions: one exchange, and no
    frame that looks ahead, as those are read anew for each row.
    """
    one = W.partitionBy(id_col)
    up, down = one.orderBy("line"), one.orderBy(F.desc("line"))
    so_far, above = up.rowsBetween(W.unboundedPreceding, 0), up.rowsBetween(W.unboundedPreceding, -1)
    to_come, below = down.rowsBetween(W.unboundedPreceding, 0), down.rowsBetween(W.unboundedPreceding, -1)
    x = bodies.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "text"))
    t = F.col("text")
    x = x.select("*", stripped(t).alias("_c"), t.rlike(FLAGS + MARK).alias("_marked"), t.rlike(FLAGS + SEPARATOR).alias("_sep"), F.lower(F.regexp_extract("text", FLAGS + HEADER, 1)).alias("_field"), attribution(t).alias("_format"))
    x = x.withColumn("_full", F.col("_c") != "")
    mark = F.when(F.col("_full"), F.col("_marked"))
    x = x.select(
        "*", F.sum((F.col("_field") == "").cast("int")).over(so_far).alias("_stretch"),
        (F.last(mark, ignorenulls=True).over(so_far) & F.last(mark, ignorenulls=True).over(to_come)).alias("_quoted"),
        F.max("_full").over(below).alias("_more"), F.max("_marked").over(below).alias("_marks_below"), (F.max("line").over(one) == F.col("line")).alias("last"),
    )
    fields = F.size(F.collect_set(F.when(F.col("_field") != "", F.col("_field"))).over(W.partitionBy(id_col, "_stretch")))
    x = x.withColumn("_block", (F.col("_field") != "") & (fields >= 2))
    x = x.withColumn("_sure", F.when(F.col("_sep"), "forward_separator").when(F.col("_block"), "header_block").when(F.col("_quoted"), "quote_marker"))
    x = x.withColumn("_attr", F.col("_sure").isNull() & F.col("_format").isNotNull() & F.coalesce("_more", F.lit(False)))
    first = lambda c: F.min(F.when(c, F.col("line"))).over(one)
    x = x.select("*", first(F.col("_sep")).alias("_sep1"), first(F.col("_block")).alias("_block1"), first(F.col("_attr") & ~F.col("_marks_below")).alias("_attr1"))
    from_sep = F.col("_sep1").isNotNull() & (F.col("_block1").isNull() | (F.col("_sep1") < F.col("_block1")))
    extent = F.when(F.col("line") > F.least("_sep1", "_block1"), F.when(from_sep, "forward_separator_unmarked_extent").otherwise("header_block_unmarked_extent"))
    x = x.withColumn("_found", F.coalesce("_sure", F.when(F.col("_attr"), "client_attribution"), extent, F.when(F.col("line") > F.col("_attr1"), "client_attribution_unmarked_extent")))
    # Signatures end with the stretch of original lines they begin in.
    own = F.col("_found").isNull()
    said = own & F.col("_full")
    x = x.select("*", F.sum((~own).cast("int")).over(so_far).alias("_run"), F.max(said).over(above).alias("_body"), F.sum(said.cast("int")).over(below).alias("_rest"), F.max(F.when(said, F.length("_c"))).over(below).alias("_widest"))
    few = (F.coalesce("_rest", F.lit(0)) <= SIGNATURE_LINES) & (F.coalesce("_widest", F.lit(0)) <= SIGNATURE_CHARS)
    starts = lambda c: F.min(F.when(own & F.col("_body") & c, F.col("line"))).over(W.partitionBy(id_col, "_run"))
    x = x.select("*", starts(t.rlike(FLAGS + DELIMITER)).alias("_delimited"), starts(t.rlike(FLAGS + SIGN_OFF) & few).alias("_signed"))
    sign = F.when(own & (F.col("line") >= F.coalesce("_delimited", "_signed")), F.when(F.col("_delimited").isNotNull(), "signature_delimiter").otherwise("signature_sign_off"))
    x = x.withColumn("_found", F.coalesce("_found", sign))
    next_own = F.last(F.when(F.col("_full"), F.col("_found").isNull()), ignorenulls=True).over(below)
    shaped = F.col("_full") & (F.length("_c") <= ATTRIBUTION_CHARS) & F.col("_c").rlike(rf"{FLAGS}^.{{0,200}}\b(?:{VERBS})\b.{{0,200}}:\s*$") & F.col("_format").isNull()
    x = x.withColumn("_near", F.coalesce(shaped & ~next_own, F.lit(False)))
    kind = F.create_map(*(F.lit(v) for kv in CLASS_OF.items() for v in kv))
    return x.select(
        id_col, "line", "text", "last", F.coalesce(F.try_element_at(kind, F.col("_found")), F.lit("original")).alias("class"),
        F.coalesce("_found", F.when(F.col("_near"), "attribution_shaped_unrecognised"), F.lit("no_structural_signal")).alias("signal"),
    )


def _wide(classified: DataFrame) -> DataFrame:
    return classified.withColumn("_width", F.length("text") + (~F.col("last")).cast("int"))


def spans(classified: DataFrame, id_col: str = "message_id") -> DataFrame:
    """id, start, end, class, signal: adjacent lines of one class and signal as one; the spans of a body tile it."""
    up = W.partitionBy(id_col).orderBy("line")
    x = _wide(classified)
    x = x.withColumn("_start", F.coalesce(F.sum("_width").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).filter("_width > 0")
    kind = F.struct("class", "signal")
    x = x.withColumn("_new", F.coalesce((F.lag(kind).over(up) != kind).cast("int"), F.lit(1)))
    x = x.withColumn("_span", F.sum("_new").over(up.rowsBetween(W.unboundedPreceding, 0)))
    g = x.groupBy(id_col, "_span", "class", "signal").agg(F.min("_start").alias("start"), F.sum("_width").alias("_n"))
    return g.select(id_col, "start", (F.col("start") + F.col("_n")).alias("end"), "class", "signal")


def views(classified: DataFrame, classes: tuple[str, ...] = ("original",), id_col: str = "message_id") -> DataFrame:
    """id, view (the text of the classes, in order), shown, hidden (characters), ambiguous (distinct lines of attribution shape).

    A body is put together in one task: as large as the body, which was one value to begin with.
    """
    x = _wide(classified)
    shown = F.col("class").isin(*classes)
    piece = F.when(shown, F.struct("line", F.concat("text", F.when(F.col("last"), "").otherwise("\n")).alias("t")))
    near = F.when(F.col("signal") == "attribution_shaped_unrecognised", stripped(F.col("text")))
    g = x.groupBy(id_col).agg(F.sort_array(F.collect_list(piece)).alias("_p"), F.sum(F.when(shown, F.col("_width")).otherwise(0)).alias("shown"), F.sum(F.when(shown, 0).otherwise(F.col("_width"))).alias("hidden"), F.count_distinct(near).alias("ambiguous"))
    return g.select(id_col, F.array_join(F.transform("_p", lambda p: p["t"]), "").alias("view"), "shown", "hidden", "ambiguous")


def class_chars(classified: DataFrame) -> DataFrame:
    """class, n_lines, chars over all bodies."""
    return _wide(classified).groupBy("class").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("_width").cast("long").alias("chars"))


def unreconciled(rows: DataFrame, before: str, after: str, declared: str) -> DataFrame:
    """Rows whose text shrank by another number of characters than was declared; a right stage has none."""
    return rows.filter(~(F.length(before) - F.length(after)).eqNullSafe(F.col(declared)))


# --- Charsets --------------------------------------------------------------------


def _decoded(raw: bytes | None, declared: str | None) -> dict | None:
    if raw is None:
        return None
    named = (declared or "").strip().strip("\"'").lower()
    try:
        known = bool(named and codecs.lookup(named))
    except LookupError:
        known = False
    for charset in ([named] if known else []) + [c for c in CHARSETS if c != named]:
        try:
            return {"text": bytes(raw).decode(charset), "charset": charset, "known": known, "replaced": 0, "fell_back": known and charset != named}
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes all bytes")


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


@F.pandas_udf(_struct(text=StringType(), charset=StringType(), known=BooleanType(), replaced=IntegerType(), fell_back=BooleanType()))
def decode_text(raw: pd.Series, declared: pd.Series) -> pd.DataFrame:
    """Bytes as text by the declared charset if it is known and fits, else by the first of CHARSETS that fits; it says which."""
    rows = [_decoded(r, d if isinstance(d, str) else None) for r, d in zip(raw, declared, strict=True)]
    names = ["text", "charset", "known", "replaced", "fell_back"]
    return pd.DataFrame([x or dict.fromkeys(names) for x in rows], columns=names)


def content_charset(c: Column) -> Column:
    """The charset parameter of a content type, without quotes, or null."""
    found = F.regexp_extract(c, r"""(?i);\s*charset\s*=\s*["']?([^;"']*)""", 1)
    return F.nullif(F.trim(found), F.lit(""))


def header_table(headers: Column) -> Column:
    """Of an array of (name, value): an array of (name in lower case, first, values in order, duplicates), in order of appearance."""
    names = F.array_distinct(F.transform(headers, lambda h: F.lower(h["name"])))

    def entry(name: Column) -> Column:
        values = F.transform(F.filter(headers, lambda h: F.lower(h["name"]).eqNullSafe(name)), lambda h: h["value"])
        return F.struct(name.alias("name"), values[0].alias("first"), values.alias("values"), (F.size(values) - 1).alias("duplicates"))

    return F.transform(names, entry)


# --- Part trees --------------------------------------------------------------------

LEAF = _struct(part_id=StringType(), depth=IntegerType(), mime_type=StringType(), filename=StringType(), attachment=BooleanType(), size=LongType(), data=StringType())


@F.pandas_udf(_struct(leaves=ArrayType(LEAF), past_depth=IntegerType(), past_count=IntegerType()))
def walk(parts: pd.Series) -> pd.DataFrame:
    """The leaves of a message's parts (structs of part_id, parent_id, place, mime_type, filename, attachment_id, size, data),
    level by level. Parts beyond MAX_PARTS and below MAX_DEPTH are not walked, but counted."""
    out = []
    for tree in parts:
        under: dict = {}
        for p in sorted(tree if tree is not None else [], key=lambda p: p["place"]):
            under.setdefault(p["parent_id"], []).append(p)
        leaves, level, seen, deep, many = [], [(p, 0) for p in under.get(None, [])], 0, 0, 0
        while level:
            following = []
            for p, depth in level:
                seen += 1
                kind = (p["mime_type"] or "").split(";")[0].strip().lower()
                children = [(c, depth + 1) for c in under.get(p["part_id"], [])]
                if seen > MAX_PARTS:
                    many += 1
                elif not kind.startswith("multipart/"):
                    leaves.append({**{k: p[k] for k in ("part_id", "filename", "size", "data")}, "depth": depth, "mime_type": kind, "attachment": bool(p["filename"]) or p["attachment_id"] is not None})
                elif depth + 1 > MAX_DEPTH:
                    deep += len(children)
                else:
                    following += children
            level = following
        out.append({"leaves": leaves, "past_depth": deep, "past_count": many})
    return pd.DataFrame(out, columns=["leaves", "past_depth", "past_count"])


def trees(parts: DataFrame) -> DataFrame:
    """message_id, leaves, past_depth, past_count from a table of parts; a message's parts meet in one task."""
    fields = ("part_id", "parent_id", "place", "mime_type", "filename", "attachment_id", "size", "data")
    together = parts.groupBy("message_id").agg(F.collect_list(F.struct(*fields)).alias("p"))
    return together.select("message_id", walk("p").alias("w")).select("message_id", "w.*")


def select_body(walked: DataFrame) -> DataFrame:
    """message_id, body (the first plain leaf with content, else the first HTML one), unused (other such leaves), attachments."""
    leaves = F.col("leaves")
    having = lambda kind: F.filter(leaves, lambda x: (x["mime_type"] == kind) & ~x["attachment"] & (F.length(stripped(F.coalesce(x["data"], F.lit("")))) > 0))
    all_ = F.concat(having("text/plain"), having("text/html"))
    files = F.transform(F.filter(leaves, lambda x: x["attachment"]), lambda x: F.struct(F.regexp_replace(x["filename"], r"\p{Cf}", "").alias("filename"), x["mime_type"].alias("mime_type"), x["size"].alias("size"), x["part_id"].alias("part_id")))
    return walked.select("message_id", F.try_element_at(all_, F.lit(1)).alias("body"), F.slice(all_, 2, MAX_PARTS).alias("unused"), files.alias("attachments"), "past_depth", "past_count")
