"""Text functions: Spark expressions where they suffice, Arrow UDFs for Unicode forms, markup and headers."""

from __future__ import annotations

import re
import unicodedata
from email.header import decode_header
from email.utils import getaddresses
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# The stop words of search terms, and the verbs that mark a decision.
STOPWORDS = (
    "a about an and any are as at be been but by can did do does for from had has have he her his how i if in is it its me my of on or our "
    "she should so that the their them then there these they this to up us was we were what when where which who whom why will with would you your"
).split()
DECISION_VERBS = "agreed approved canceled cancelled chose chosen confirmed decided declined rejected resolved settled signed".split()
ADDRESS = r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
TRUNCATE_TOKENS = 250
#: What no word has in it; written out so that other engines read it too.
EDGE = r"[^\p{L}\p{M}\p{N}_]"
# The classes of questions, by the first pattern that is found anywhere.
QUESTIONS = [
    ("when", r"\bwhen\b|\bwhat (?:time|date|day)\b|\bwhat's the date\b"),
    ("how_much", r"\bhow (?:much|many)\b|\bwhat (?:price|cost|amount|total)\b"),
    ("did_we_decide", r"\bdid (?:we|they|you|i) (?:decide|agree|approve|settle|choose|pick|sign off)\b|\bwas it (?:decided|agreed|approved)\b|\bwhat did (?:we|they) (?:decide|agree|choose)\b"),
    ("who", r"\bwho\b|\bwhom\b"), ("where", r"\bwhere\b"), ("why", r"\bwhy\b"), ("which", r"\bwhich\b"), ("how", r"\bhow\b"), ("what", r"\bwhat\b"),
]
#: Characters of markup that the parser is fed at once; pages are read whole.
MAX_MARKUP = 2_000_000


def lower_collapsed(c: Column) -> Column:
    """Lower case, white space collapsed: what fold() gives for ASCII."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\f\x0B]+", " "))


def case_folded(c: Column) -> Column:
    """Case folding in expressions: lower case, a sharp s as ss, a final sigma as any other."""
    return F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "ς", "σ")


def has_word(c: Column, word: str) -> Column:
    """Whether the text holds the word whole, in any case: no letter, mark, digit or underscore of any script beside it."""
    w = re.escape(word.casefold())
    return case_folded(c).rlike(rf"(^|{EDGE}){w}({EDGE}|$)")


def content_tokens(c: Column) -> Column:
    """Words of a text of any script in order, case-folded, trimmed of trailing dots and dashes, without stop words."""
    found = F.regexp_extract_all(case_folded(c), F.lit(r"([\p{L}\p{N}_'/@.-]+)"), F.lit(1))
    trimmed = F.transform(found, lambda w: F.regexp_replace(w, r"[.-]+$", ""))
    return F.filter(trimmed, lambda w: w.rlike(r"[\p{L}\p{N}]") & ~w.isin(STOPWORDS))


def count_tokens(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def head_truncate(c: Column, n: int = TRUNCATE_TOKENS) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " ")), " "), 1, n), " ")


def from_base64url(c: Column) -> Column:
    """Unpadded base64url to bytes; text that is not base64url gives null."""
    plain = F.translate(c, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("="))
    return F.when(c.rlike("^[A-Za-z0-9_-]*$") & (F.length(c) % 4 != 1), F.unbase64(padded))


def message_ids_in(c: Column) -> Column:
    """Distinct message ids of a header, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(<[^<>\s]{1,900}>)"), F.lit(1)))


def strip_reply_prefixes(c: Column) -> Column:
    marks = "re|aw|antw|sv|vs|odp|res|rif|ref|fw|fwd|wg|tr|doorst|enc|rv|pd"  # fixed values: reply and forward marks
    return F.regexp_replace(c, rf"(?i)^(?:\s*(?:{marks})(?:\s*[\[(]\s*\d+\s*[\])])?\s*:\s*)+", "")


# The forms of structured identifiers, in the order in which they are tried; what may stand around one.
IDENTIFIERS = {"message_id": r"<[^<>\s@]+@[^<>\s@]+>", "tracking": r"1Z[0-9A-Z]{16}|[0-9]{12}|[0-9]{15}|[0-9]{20,22}|[A-Z]{2}[0-9]{9}[A-Z]{2}", "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"}
AROUND = r"^[\"'(\[{,;:.!?]+|[\"')\]},;:.!?]+$"


def identifier_kind(c: Column) -> Column:
    """message_id, tracking, iban, reference, or null, in this order."""
    x = F.regexp_replace(c, AROUND, "")
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    forms = [F.when((c if k == "message_id" else x).rlike(f"^(?:{p})$"), k) for k, p in IDENTIFIERS.items()]
    return F.coalesce(*forms, F.when((F.length(x) >= 6) & (digits >= 2) & x.rlike("^[A-Za-z0-9#/_-]+$"), "reference"))


def identifier_of(token: str) -> str | None:
    """identifier_kind() of one token, for the parts of a query."""
    x = re.sub(AROUND, "", token)
    found = (k for k, p in IDENTIFIERS.items() if re.fullmatch(p, token if k == "message_id" else x))
    reference = len(x) >= 6 and len(re.sub("[^0-9]", "", x)) >= 2 and re.fullmatch("[A-Za-z0-9#/_-]+", x)
    return next(found, "reference" if reference else None)


def interrogative(c: Column) -> Column:
    """The first class of question that is found in a text, or null."""
    t = lower_collapsed(c)
    return F.coalesce(*(F.when(t.rlike("(?U)" + pattern), name) for name, pattern in QUESTIONS))


def fold_text(x: str | None) -> str | None:
    return None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split())


def normalise_text(x: str | None) -> str | None:
    if x is None:
        return None
    x = re.sub(r"[ \t\f\v ]+", " ", unicodedata.normalize("NFKC", x))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", x)).strip()


def strip_invisible_text(x: str | None) -> str | None:
    return None if x is None else "".join(c for c in x if unicodedata.category(c) != "Cf")


def decode_words_text(x: str | None) -> str | None:
    """RFC 2047 words decoded; what cannot be is kept with replacement characters."""
    if x is None:
        return None
    out = []
    for part, charset in decode_header(x):
        if isinstance(part, bytes):
            try:
                part = part.decode(charset or "ascii", "replace")
            except LookupError:
                part = part.decode("latin-1")
        out.append(part)
    return "".join(out)


def addresses_text(x: str | None) -> list[dict] | None:
    """Distinct (display, address) of a header; None where the header was not observed."""
    if x is None:
        return None
    seen = dict.fromkeys((d.strip(), a.lower()) for d, a in getaddresses([x]) if "@" in a)
    return [{"display": d, "address": a} for d, a in seen]


class _Visible(HTMLParser):
    DROPPED = {"script", "style", "head", "noscript", "template", "title"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?:px|pt|em|rem|%)?\s*(?:;|!|$)|(?:width|height)\s*:\s*[01](?:px)?\s*(?:;|$)", re.I)

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        tiny = tag == "img" and {a.get("width"), a.get("height")} & {"0", "1"}
        hidden = tag in self.DROPPED or "hidden" in a or bool(self.HIDDEN.search(a.get("style") or "")) or bool(tiny)
        if tag not in self.VOID:
            self.open.append((tag, hidden))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if data.strip() and not any(h for _, h in self.open):
            self.text.append(data.strip())


def visible_text(html: str | None) -> str | None:
    """The text of a page that a reader sees, a line for each stretch; null for no page."""
    if html is None:
        return None
    p = _Visible()
    for i in range(0, len(html), MAX_MARKUP):
        p.feed(html[i : i + MAX_MARKUP])
    p.close()
    return "\n".join(p.text)


def _series(f):
    def apply(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return apply


fold = F.pandas_udf(_series(fold_text), StringType())
normalise = F.pandas_udf(_series(normalise_text), StringType())
strip_invisible = F.pandas_udf(_series(strip_invisible_text), StringType())
decode_encoded_words = F.pandas_udf(_series(decode_words_text), StringType())
addresses_in_header = F.pandas_udf(_series(addresses_text), ArrayType(StructType([StructField("display", StringType()), StructField("address", StringType())])))
html_visible = F.pandas_udf(_series(visible_text), StringType())


def register(spark: SparkSession) -> None:
    """Installs the UDFs for SQL."""
    for name, f in {"fold": fold, "normalise": normalise, "strip_invisible": strip_invisible, "decode_encoded_words": decode_encoded_words, "addresses_in_header": addresses_in_header, "html_visible": html_visible}.items():
        spark.udf.register(name, f)
