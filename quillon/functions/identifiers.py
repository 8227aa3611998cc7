"""Scalar functions on identifiers, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types, exclusions, check weights and confusions that results depend on.
STRONG_TYPES = ("PHONE", "ACCOUNT", "DEVICE", "ID_CARD", "NAME", "ORGANIZATION", "MERCHANT", "IP")
CORROBORATION = {
    "NAME": ("PHONE", "ID_CARD", "ACCOUNT", "ORGANIZATION", "DEVICE"),
    "ORGANIZATION": ("ACCOUNT", "PHONE", "ID_CARD", "MERCHANT", "IP"),
}
EXCLUDED = {
    "PHONE": ("10086", "10010", "10000", "110", "119", "120", "122", "13800138000"),
    "IP": ("127.0.0.1", "0.0.0.0", "192.168.0.1", "192.168.1.1"),
}
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
OCR_PAIRS = (("0", "O"), ("1", "l"), ("8", "B"))

_FULL = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_HALF = "".join(chr(0x21 + i) for i in range(94)) + " "


def to_halfwidth(c: Column) -> Column:
    return F.translate(c, _FULL, _HALF)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def normalize_identifier(kind: Column, surface: Column) -> Column:
    """The value that mentions are compared by; masked phones and accounts keep `*`."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  (x is made once, however often f names it)

    def compacted(half: Column, compact: Column) -> Column:
        star = F.regexp_replace(F.regexp_replace(compact, "[*xX×]", "*"), r"[^0-9*]", "")
        masked = compact.rlike("[*xX×]")
        phone_mask = F.when(star.startswith("861") & (F.length(digits(star)) >= 11), F.substr(star, F.lit(3))).otherwise(star)
        plain = digits(compact)
        phone = F.when(plain.startswith("86") & (F.length(plain) == 13), F.substr(plain, F.lit(3))).otherwise(plain)
        return (
            F.when(kind == "MERCHANT", F.regexp_replace(half, r"(?U)\s+", ""))
            .when(kind == "PHONE", F.when(masked, phone_mask).otherwise(phone))
            .when(kind == "ACCOUNT", F.when(masked, star).otherwise(plain))
            .when(kind.isin("DEVICE", "ID_CARD"), plain)
            .when(kind == "ORGANIZATION", F.regexp_replace(compact, r"(?U)[\s()（）]", ""))
            .otherwise(compact)
        )

    whole = once(to_halfwidth(F.coalesce(surface, F.lit(""))), lambda half: once(F.regexp_replace(half, r"(?U)[\s\-_./]", ""), lambda compact: compacted(half, compact)))
    # most surfaces are digits alone, or letters of which nothing goes
    bare = F.when((kind == "PHONE") & surface.startswith("86") & (F.length(surface) == 13), F.substr(surface, F.lit(3))).otherwise(surface)
    letters = kind.isin("NAME", "ORGANIZATION", "MERCHANT") & surface.rlike("^[A-Za-z0-9一-鿿]+\\z")
    return F.when(surface.rlike("^[0-9]+\\z"), bare).when(letters, surface).otherwise(whole)


def luhn_ok(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False)) & F.coalesce(F.call_function("luhn_check", c), F.lit(False))


def id_card_ok(c: Column) -> Column:
    total = None
    for i, w in enumerate(ID_WEIGHTS):
        part = F.try_to_number(F.substr(c, F.lit(i + 1), F.lit(1)), F.lit("9")) * w
        total = part if total is None else total + part
    check = F.substr(F.lit(ID_CHECKS), (total % 11 + 1).cast("int"), F.lit(1))
    return F.coalesce(c.rlike("^[0-9]{17}[0-9Xx]$") & (F.upper(F.substr(c, F.lit(18), F.lit(1))) == check), F.lit(False))


def possible_forms(c: Column) -> Column:
    """Readings of a surface under OCR confusions and without a country prefix, sorted."""
    forms = [F.replace(c, F.lit(a), F.lit(b)) for x in OCR_PAIRS for a, b in (x, x[::-1])]
    forms.append(F.when(c.startswith("86") & (F.length(c) == 13), F.substr(c, F.lit(3))).otherwise(c))
    return F.array_sort(F.array_except(F.array_distinct(F.array(*forms)), F.array(c)))


def mask_collide_ok(kind: Column, value: Column) -> Column:
    """Whether a masked value shows enough digits to be compared."""
    d = digits(value)
    phone = (F.length(d) >= 7) & value.startswith("1") & F.endswith(value, F.right(d, F.lit(4)))
    ok = F.when(kind == "PHONE", phone).when(kind == "ACCOUNT", F.length(d) >= 10).otherwise(False)
    return F.coalesce(value.contains("*") & ok, F.lit(False))


def public_surface(surface: Column, kind: Column) -> Column:
    """How a surface may be shown. The untyped digit rules come before the later types."""
    d, s = digits(surface), surface
    n = F.length(d)
    kind = F.coalesce(kind, F.lit(""))
    stars = lambda k: F.repeat(F.lit("*"), k)
    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit(""))
        .when(((kind == "PHONE") | ((n == 11) & d.startswith("1"))) & (n >= 7), F.concat(F.left(d, F.lit(3)), F.lit("****"), F.right(d, F.lit(4))))
        .when(((kind == "ACCOUNT") | n.between(16, 19)) & (n >= 8), F.concat(F.left(d, F.lit(4)), stars(n - 8), F.right(d, F.lit(4))))
        .when((kind == "ID_CARD") & (n == 18), F.concat(F.left(d, F.lit(4)), stars(F.lit(10)), F.right(d, F.lit(4))))
        .when((kind == "DEVICE") & (n >= 8), F.concat(stars(n - 4), F.right(d, F.lit(4))))
        .when((kind == "IP") & (F.size(F.split(s, r"\.")) == 4), F.concat(F.substring_index(s, ".", 2), F.lit(".*.*")))
        .otherwise(s)
    )


def is_excluded(kind: Column, value: Column) -> Column:
    out = F.lit(False)
    for k, values in EXCLUDED.items():
        out = out | ((kind == k) & value.isin(*values))
    return F.coalesce(out, F.lit(False))


def candidate_fingerprint(kind: Column, value: Column, cases: Column) -> Column:
    """sha256 of the compact JSON with sorted keys; nulls are kept."""
    body = F.struct(F.array_sort(cases).alias("case_ids"), value.alias("normalized_value"), kind.alias("object_type"))
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def payload_hash(kind: str, surface: str, start: str, producer: str) -> Column:
    """sha256 of a mention's compact JSON with sorted keys; nulls are kept."""
    body = F.struct(F.col(producer).alias("producer"), F.col(start).alias("start"), F.col(surface).alias("surface"), F.col(kind).alias("type"))
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)
