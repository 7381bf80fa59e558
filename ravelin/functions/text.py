"""Text functions. Regular expressions are for Java with (?U): \\b, \\s and \\S
know Unicode. Undefined results are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 6000


def word_count(text: Column) -> Column:
    """Runs of characters that are no Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def find(text: Column, pattern: str) -> Column:
    """Characters before the first match; null without one."""
    at = F.regexp_instr(text, F.lit(f"(?iU){pattern}"))
    return F.when(at > 0, at - 1)


def byte_offset(text: Column, chars: Column) -> Column:
    """Bytes before a place given in characters."""
    return F.octet_length(F.substring(text, F.lit(1), chars))


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, f"(?iU){pattern}", group), F.lit(""))


def non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def normalise_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_verbatim(span: Column, text: Column) -> Column:
    """Whether a span that is not blank lies in the text, white space aside."""
    s, t = normalise_whitespace(span), normalise_whitespace(text)
    return F.coalesce((s != "") & t.contains(s), F.lit(False))


def truncated(text: Column, most: int = MAX_CHARS) -> tuple[Column, Column]:
    """The text cut to so many characters, and whether it was."""
    return F.substring(text, 1, most), F.char_length(text) > most


def length_bucket(n: Column, cuts=(15, 40)) -> Column:
    """Half-open bins named after the cuts."""
    lo, hi = cuts
    return F.when(n < lo, f"<{lo}").when(n < hi, f"{lo}-{hi}").otherwise(f">={hi}")


def right_closed(n: Column, cuts=(2, 5, 10, 20, 50, 100, 500)) -> Column:
    """Bins (a, b] named a+1-b; what lies at or below the first cut is in 1-cut."""
    out = F.lit(f">{cuts[-1]}")
    for lo, hi in reversed([(0, cuts[0]), *zip(cuts, cuts[1:], strict=False)]):
        out = F.when(n <= hi, f"{lo + 1}-{hi}").otherwise(out)
    return out


def template(parts: dict[str, Column], layout: str, blank: str = "(none)") -> Column:
    """layout with each {name} replaced by its column (blank where empty or null);
    braces in the data stay as they are."""
    out, rest = [], layout
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), F.when(F.trim(F.coalesce(parts[name], F.lit(""))) == "", F.lit(blank)).otherwise(parts[name])]
    return F.concat(*out, F.lit(rest))


def note_code(note: Column, codes: dict[str, str]) -> Column:
    """A free note as a code: Turkish letters folded, lower case, letters only, and
    then the whole note looked up. A note that is no code stays as it is, trimmed;
    blank ones are null."""
    kept = F.nullif(F.trim(note), F.lit(""))
    folded = F.lower(F.translate(kept, "çğıöşüâîûÇĞİIÖŞÜ", "cgiosuaiucgiiosu"))
    plain = F.regexp_replace(folded, r"[^\p{L}]", "")
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[plain], kept) if codes else kept


def common_prefix_length(least: Column, most: Column) -> Column:
    """Length of the prefix that all strings share, from their minimum and maximum."""
    n = F.least(F.char_length(least), F.char_length(most))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(least, F.lit(1), i) == F.substring(most, F.lit(1), i))
    return F.when(n == 0, 0).otherwise(F.size(F.filter(same, lambda x: x)))


def valid_label(payload: Column, labels, fields, known: dict | None = None) -> Column:
    """Whether a JSON object has exactly the fields, a known label in the first, and
    in each field of known one of its values."""
    keys = F.json_object_keys(payload)
    ok = F.array_sort(keys) == F.array(*[F.lit(f) for f in sorted(fields)])
    for field, values in ({fields[0]: labels} | (known or {})).items():
        ok = ok & F.get_json_object(payload, f"$.{field}").isin(*values)
    return F.coalesce(ok, F.lit(False))


def percent(share: float | None, digits: int = 1) -> str:
    """A share as text for reports, on the driver; a dash if it is not known."""
    return "-" if share is None else f"{share * 100:.{digits}f}%"


def thousands(n: int | None) -> str:
    """A count as text for reports."""
    return "-" if n is None else f"{n:,}"


def times(ratio: float | None, digits: int = 2) -> str:
    """A ratio as text for reports."""
    return "-" if ratio is None else f"{ratio:.{digits}f}×"
