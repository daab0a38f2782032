"""String functions over columns: all built-in expressions, so they stay in generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def _without_marks(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c.lower()) if not "\u0300" <= x <= "\u036f")


#: Lower-case letters that are one of a to z and accents, what they are without, and the accents by themselves, which go.
_MARKED = [chr(c) for c in range(0xC0, 0x1F00) if chr(c).lower() == chr(c) and _without_marks(chr(c)) in set("abcdefghijklmnopqrstuvwxyz")]
ACCENTED = "".join(_MARKED) + "".join(map(chr, range(0x300, 0x370)))
PLAIN = "".join(map(_without_marks, _MARKED))
#: Named entities in any case of letters, in the order in which they are decoded (so &amp;lt; is a tag's sign in the end).
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"))
CDATA = r"(?s)<!\[CDATA\[(.*?)\]\]>"
#: Patterns of sentences and of numbers with their units.
SENTENCE = r"[^.!?]+[.!?]+|[^.!?]+$"
NUMBER = r"\b\d+(?:[.,]\d+)?(?:\s?(?:%|€|\$|euros?|dollars?|km|milliards?|millions?|ans?|mois|jours?|heures?|morts?|blessés?|disparus?|personnes?))?\b"


def js_regex(pattern: str) -> str:
    r"""pattern with \b as ECMAScript has it: between ASCII word characters and others only."""
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def clean(x: Column) -> Column:
    """One blank for every run of white space (of any Unicode kind), none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def fold(x: Column) -> Column:
    """Lower case without accents; punctuation stays."""
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def normalise(x: Column, keep: str = "") -> Column:
    """fold(), then one blank for all that isn't a-z, 0-9 or in keep."""
    return F.trim(F.regexp_replace(fold(clean(x)), f"[^a-z0-9{keep}]+", " "))


def plain_text(x: str) -> str:
    """normalise_terms() of a value that is known beforehand."""
    return plain_topic(x.replace("œ", "oe").replace("Œ", "oe").replace("æ", "ae").replace("Æ", "ae"))


def plain_topic(x: str) -> str:
    """normalise() of a value that is known beforehand."""
    plain = _without_marks(x)
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in plain).split())


def fold_known(x: str, keep: str = "") -> str:
    """normalise(), keeping some signs, of a value that is known beforehand."""
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" + keep else " " for c in _without_marks(x)).split())


def normalise_terms(x: Column) -> Column:
    """As normalise(), with both ligatures written out."""
    own = F.coalesce(x, F.lit(""))
    for ligature, letters in (("œ", "oe"), ("æ", "ae")):
        own = F.replace(F.replace(own, F.lit(ligature), F.lit(letters)), F.lit(ligature.upper()), F.lit(letters))
    return normalise(own)


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x worked out once however often use names it."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _decode_codes(x: Column, pattern: str, base: int) -> Column:
    """Numeric references as characters of 16 bits (halves of a pair become U+FFFD)."""
    code = lambda c: F.coalesce((c.try_cast("decimal(38,0)") if base == 10 else F.conv(c, 16, 10).try_cast("decimal(38,0)")) % 65536, F.lit(0)).cast("int")
    sign = lambda n: F.decode(F.unhex(F.lpad(F.hex(F.when(n.between(0xD800, 0xDFFF), 0xFFFD).otherwise(n)), 4, "0")), "UTF-16BE")
    signs = lambda v: F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(1)), lambda c: _bound(code(c), sign))
    joined = lambda v: F.array_join(F.zip_with(F.split(v, pattern), signs(v), lambda part, own: F.concat(F.coalesce(part, F.lit("")), F.coalesce(own, F.lit("")))), "")
    return _bound(x, lambda v: F.when(F.contains(v, F.lit("&#")), joined(v)).otherwise(v))


def decode_entities(x: Column) -> Column:
    """CDATA sections opened, then named entities, then decimal and hexadecimal references; texts without either pass as they are."""

    def decoded(v: Column) -> Column:
        v = F.regexp_replace(v, CDATA, "$1")
        for names, sign in ENTITIES:
            v = F.regexp_replace(v, f"(?i){names}", sign)
        return _decode_codes(_decode_codes(v, "&#([0-9]+);", 10), "(?i)&#x([0-9a-f]+);", 16)

    return _bound(x, lambda v: F.when(F.contains(v, F.lit("&")) | F.contains(v, F.lit("<![CDATA[")), decoded(v)).otherwise(v))


def strip_html(x: Column) -> Column:
    """Entities decoded, then script and style blocks and tags removed: an escaped tag is a tag."""
    x = decode_entities(F.coalesce(x, F.lit("")))
    for block in ("script", "style"):
        x = F.regexp_replace(x, f"(?is)<{block}.*?</{block}>", " ")
    return clean(F.regexp_replace(x, r"<[^>]+>", " "))


def strip_publisher(title: Column) -> Column:
    """title without a trailing ' - publisher' of 2 to 45 characters."""
    return F.regexp_replace(title, r"\s+-\s+[^-]{2,45}$", "")


def tokens(x: Column, least: int = 4, stop: Sequence[str] = (), most: int | None = None) -> Column:
    """Distinct words of normalise(x) with `least` characters or more that aren't in stop, in order of first sight, the first `most`."""
    found = F.array_distinct(F.filter(F.split(normalise(x), " "), lambda t: (F.length(t) >= least) & ~t.isin(*stop) if stop else F.length(t) >= least))
    return F.slice(found, 1, most) if most else found


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def numeric_claims(x: Column) -> Column:
    """Numbers with their units, in any case of letters."""
    return F.regexp_extract_all(clean(x), F.lit("(?iu)" + js_regex(NUMBER)), F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two arrays of distinct tokens; 0 if one is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def extractive_summary(x: Column, sentences_most: int = 5, least: int = 36, chars: int = 1000) -> Column:
    """The first sentences that are long enough, joined and cut."""
    return F.substring(F.array_join(F.slice(F.filter(sentences(x), lambda s: F.length(s) >= least), 1, sentences_most), " "), 1, chars)


#: Stop words of titles by what they are compared for, and what stands where a summary is missing.
VISUAL_STOP = ("avec", "dans", "pour", "plus", "apres", "avant", "cette", "sont", "etre", "leur", "leurs", "tout", "mais", "sans", "vers", "entre", "une", "des", "les", "sur", "qui", "que", "aux")
PHOTO_STOP = ("avec", "dans", "pour", "plus", "apres", "avant", "cette", "sont", "etre", "leur", "leurs", "tout", "mais", "sans", "vers", "entre", "une", "des", "les", "sur", "qui", "que", "aux", "par", "ses", "son", "ont", "est", "fait", "article", "parisien")
NEWS_STOP = ("avec", "dans", "pour", "plus", "apres", "avant", "cette", "sont", "etre", "leur", "leurs", "tout", "mais", "sans", "vers", "entre", "une", "des", "les", "sur", "qui", "que", "aux", "par", "ses", "son", "ont", "est", "aux", "etats", "unis", "article", "direct")
QUERY_STOP = tuple("avec dans pour plus apres avant cette cet ces sont etre leur leurs tout tous mais sans vers entre une des les sur qui que aux par son ses est fait font comme dont elle elles ils nous vous notre votre aussi encore deja tres moins depuis alors chez contre lors peut peuvent avait avoir sera un le la du de au en et ou ce se sa ne pas actualite direct video photos photo selon annonce nouvelle nouveau nouvelles nouveaux article".split())
SUMMARY_STOP = tuple("avec dans pour plus apres avant cette cet ces sont etre leur leurs tout tous mais sans vers entre une des les sur qui que aux par son ses est fait font comme dont elle elles ils nous vous notre votre aussi encore deja tres moins depuis alors chez contre lors peut peuvent avait avoir sera un le la du de au en et ou ce se sa ne pas article direct video selon".split())
PLACEHOLDER = r"ouvrez?\s+l[’']article|consultez?\s+(?:les?\s+)?détails|détails publiés par la source|résumé indisponible"
SITE_ENDS = r"\.(?:fr|com|net|org|be|ch)$"


def without_placeholder(x: Column) -> Column:
    """clean(), or nothing where it only says that a summary is missing."""
    own = clean(x)
    return F.when(F.lower(own).rlike(PLACEHOLDER), "").otherwise(own)


def without_source(title: Column, source: Column, signs: str) -> Column:
    """clean(title) without a source at its end that one of signs and blanks part from it; in any case of letters."""
    own, name = clean(title), clean(source)
    quoted = F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    tail = F.concat(F.lit(rf"(?iu)\s*[{signs}]\s*"), quoted, F.lit(r"\s*$"))
    return F.when((own == "") | (name == ""), own).otherwise(F.trim(F.regexp_replace(own, tail, F.lit(""))))


def display_title(title: Column, source: Column) -> Column:
    return without_source(title, source, "-–—|·:")


def story_title(title: Column, source: Column) -> Column:
    """display_title(), and without a last ' - site' that ends like a host."""
    own = display_title(title, source)
    tail = F.regexp_extract(own, r"\s+[-–—|]\s+[^–—|]{2,42}$", 0)
    return F.when(tail.rlike(f"(?i){SITE_ENDS}"), F.trim(F.substring(own, F.lit(1), F.length(own) - F.length(tail)))).otherwise(own)


def title_numbers(title: Column, source: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normalise(story_title(title, source)), F.lit(js_regex(r"\b[0-9]+\b")), F.lit(0)))


def query_variants(title: Column) -> Column:
    """What to search for a title with: quoted, plain, its first nine of more than ten words, its first eight tokens."""
    plain = F.substring(F.regexp_replace(clean(title), r"\s+[-–—|]\s+[^-–—|]{2,60}$", ""), 1, 220)
    words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
    some = F.filter(F.array_distinct(F.split(normalise(plain), " ")), lambda w: (w != "") & ~w.isin(*QUERY_STOP) & ((F.length(w) >= 4) | w.rlike("[0-9]")))
    ways = F.array(F.concat(F.lit('"'), plain, F.lit('"')), plain, F.when(F.size(words) > 10, F.array_join(F.slice(words, 1, 9), " ")).otherwise(""), F.array_join(F.slice(some, 1, 8), " "))
    return F.array_distinct(F.filter(ways, lambda w: w != ""))


def search_subject(title: Column) -> Column:
    """The part after the last colon if it has six words, else all; without a publisher."""
    own = F.substring(F.regexp_replace(strip_html(title), r"\s+[-–—]\s+[^-–—]{2,90}$", ""), 1, 240)
    parts = F.filter(F.transform(F.split(own, r"\s*[:：]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    tail = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(own)
    return F.when(F.size(F.filter(F.split(tail, r"\s+"), lambda w: w != "")) >= 6, tail).otherwise(own)


def aggregate_headlines(x: Column) -> Column:
    """Every other part between wide gaps, five at most; none of fewer than four parts."""
    parts = F.filter(F.transform(F.split(decode_entities(F.coalesce(x, F.lit(""))), r"\s{2,}"), clean), lambda p: p != "")
    return F.when(F.size(parts) < 4, F.array().cast("array<string>")).otherwise(F.slice(F.filter(parts, lambda _, i: i % 2 == 0), 1, 5))


def fingerprint(title: Column, summary: Column, chars: int) -> Column:
    """Title and the first chars characters of the summary, normalised: equal ones tell the same."""
    return normalise(F.concat_ws("|", F.coalesce(title, F.lit("")), F.substring(F.coalesce(summary, F.lit("")), 1, chars)), "%€$")


def escape_html(x: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(sign), F.lit(name))
    return x


def bounded(x: Column, fallback: float, least: float, most: float) -> Column:
    """x, a string, as a number between least and most; fallback where it is none, 0 where it is blank."""
    number = F.when(F.trim(x) == "", 0.0).otherwise(x.try_cast("double"))
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(finite, F.lit(fallback))))


def agreement(found: Column, wanted: Column) -> Column:
    """Of two arrays of distinct words: hits, and their share of the longer, of the shorter and of wanted; 0 if one is empty."""
    hits = F.size(F.array_intersect(wanted, found))
    share = lambda n: F.coalesce(hits / F.nullif(n, F.lit(0)), F.lit(0.0))
    sizes = F.size(wanted), F.size(found)
    return F.struct(hits.cast("long").alias("hits"), share(F.greatest(*sizes)).alias("of_longer"), share(F.least(*sizes)).alias("of_shorter"), share(F.when(sizes[1] > 0, sizes[0]).otherwise(0)).alias("of_wanted"))


def overlap_ratio(a: Column, b: Column, least: int = 5, most: int = 70) -> Column:
    """The share of a's first words that are among b's first; 0 with fewer than least words (distinct ones, in b)."""
    words = lambda x: F.slice(F.filter(F.split(normalise(x), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*SUMMARY_STOP)), 1, most)
    own, other = words(a), F.array_distinct(words(b))
    return F.when((F.size(own) < least) | (F.size(other) < least), 0.0).otherwise(F.size(F.filter(own, lambda w: F.array_contains(other, w))) / F.size(own))
