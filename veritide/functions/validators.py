"""Semantic types as Column expressions: a screen by pattern, and check characters by higher-order functions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


def _values(c: Column) -> Column:
    """Numbers of the characters: digits as they are, letters from 10, then the three signs of a CUSIP."""
    signs = lambda x: F.when(x == "*", 36).when(x == "@", 37).when(x == "#", 38)
    return F.transform(F.split(F.upper(c), ""), lambda x: F.coalesce(signs(x), F.ascii(x) - F.when(x.between("0", "9"), 48).otherwise(55)))


def _expanded(c: Column) -> Column:
    """Digits after each letter is replaced by its number from 10."""
    return F.split(F.array_join(F.transform(_values(c), lambda v: v.cast("string")), ""), "")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda acc, v: acc + v)


def _weighted(a: Column, weights: tuple[int, ...]) -> Column:
    return _sum(F.transform(a, lambda v, i: v * F.element_at(F.array(*map(F.lit, weights)), i % len(weights) + 1)))


def _digit_sum(v: Column) -> Column:
    return F.floor(v / 10).cast("int") + v % 10


def _luhn_from_right(digits: Column) -> Column:
    """Luhn over an array of digit texts."""
    doubled = F.transform(
        F.reverse(digits), lambda d, i: F.when(i % 2 == 1, _digit_sum(d.cast("int") * 2)).otherwise(d.cast("int"))
    )
    return _sum(doubled) % 10 == 0


def _mod97(c: Column) -> Column:
    return F.aggregate(
        _expanded(c), F.lit(0), lambda acc, d: (acc * 10 + d.cast("int")) % 97
    )


def _checked(c: Column, screen: str, check: Callable[[Column], Column] | None = None) -> Column:
    """False where the screen fails, so that the check never sees other shapes; null stays null."""
    fits = c.rlike(screen)
    return fits if check is None else F.when(fits, check(c)).otherwise(F.when(c.isNotNull(), False))


def isin(x) -> Column:
    return _checked(col(x), r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$", lambda c: _luhn_from_right(_expanded(c)))


def sedol(x) -> Column:
    return _checked(col(x), r"^[B-DF-HJ-NP-TV-Z0-9]{6}[0-9]$", lambda c: _weighted(_values(c), (1, 3, 1, 7, 3, 9, 1)) % 10 == 0)


def cusip(x) -> Column:
    def check(c: Column) -> Column:
        body = F.transform(
            _values(F.substring(c, 1, 8)), lambda v, i: _digit_sum(F.when(i % 2 == 1, v * 2).otherwise(v))
        )
        return (10 - _sum(body) % 10) % 10 == F.substring(c, 9, 1).cast("int")

    return _checked(col(x), r"^[A-Z0-9*@#]{8}[0-9]$", check)


def figi(x) -> Column:
    def check(c: Column) -> Column:
        body = F.transform(
            _values(F.substring(c, 1, 11)), lambda v, i: _digit_sum(F.when(i % 2 == 1, v * 2).otherwise(v))
        )
        return (10 - _sum(body) % 10) % 10 == F.substring(c, 12, 1).cast("int")

    return _checked(col(x), r"^(?!BS|BM|GG|GB|GH|KY|VG)[B-DF-HJ-NP-TV-Z]{2}G[B-DF-HJ-NP-TV-Z0-9]{8}[0-9]$", check)


def lei(x) -> Column:
    return _checked(col(x), r"^[A-Z0-9]{18}[0-9]{2}$", lambda c: _mod97(c) == 1)


#: Lengths of account numbers by country, as registered at the end of 2024.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def iban(x) -> Column:
    lengths = F.create_map(*[F.lit(v) for kv in IBAN_LENGTHS.items() for v in kv])

    def check(c: Column) -> Column:
        length = F.coalesce(F.try_element_at(lengths, F.substring(c, 1, 2)), F.lit(0))
        return (F.length(c) == length) & (_mod97(F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))) == 1)

    return _checked(F.upper(F.replace(col(x), F.lit(" "), F.lit(""))), r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", check)


def bic(x) -> Column:
    return _checked(col(x), r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$")


def mic(x) -> Column:
    return _checked(col(x), r"^[A-Z0-9]{4}$")


def _digits(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda d: d.cast("int"))


def aba_routing(x) -> Column:
    return _checked(col(x), r"^[0-9]{9}$", lambda c: _weighted(_digits(c), (3, 7, 1)) % 10 == 0)


def uti(x) -> Column:
    return _checked(col(x), r"^[A-Z0-9]{18}[0-9]{2}[A-Z0-9]{1,32}$")


def upi(x) -> Column:
    return _checked(col(x), r"^QZ[A-Z0-9]{10}$")


def gtin(x) -> Column:
    return _checked(
        col(x), r"^([0-9]{8}|[0-9]{12,14})$", lambda c: _weighted(F.reverse(_digits(c)), (1, 3)) % 10 == 0
    )


def npi(x) -> Column:
    return _checked(col(x), r"^[12][0-9]{9}$", lambda c: F.call_function("luhn_check", F.concat(F.lit("80840"), c)))


def card_number(x) -> Column:
    return _checked(
        F.regexp_replace(col(x), r"[ -]", ""), r"^[0-9]{12,19}$", lambda c: F.call_function("luhn_check", c)
    )


def email(x) -> Column:
    return _checked(col(x), r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")


def uuid(x) -> Column:
    return _checked(col(x), r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def ulid(x) -> Column:
    return _checked(col(x), r"^[0-7][0-9A-HJKMNP-TV-Z]{25}$")


def iso_date(x) -> Column:
    return _checked(
        col(x), r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()
    )


def hex_colour(x) -> Column:
    return _checked(col(x), r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$")


def ipv4(x) -> Column:
    return _checked(col(x), r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")


VALIDATORS: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (
        isin, sedol, cusip, figi, lei, iban, bic, mic, aba_routing, uti, upi, gtin, npi, card_number, email, uuid, ulid,
        iso_date, hex_colour, ipv4,
    )
}


def register_validator(name: str, build: Callable[..., Column]) -> None:
    """Add a semantic type; a name can't be taken twice."""
    if name in VALIDATORS:
        raise ValueError(f"{name} is taken")
    VALIDATORS[name] = build


# Currency codes of 2021, and what changed on later days.
_CURRENCIES = frozenset(
    """AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF
    CHW CLF CLP CNY COP COU CRC CUC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD
    HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL
    MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD
    RUB RWF SAR SBD SCR SDG SEK SGD SHP SLL SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN
    UYI UYU UYW UZS VED VES VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XDR XOF XPD XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWL""".split()
)
_CURRENCY_CHANGES = (
    (date(2023, 1, 1), {"SLE"}, {"HRK", "CUC"}),
    (date(2024, 4, 5), {"ZWG"}, set()),
    (date(2025, 3, 31), {"XCG"}, {"ZWL"}),
    (date(2026, 3, 31), set(), {"ANG"}),
)


def _currencies() -> dict[date, tuple[str, ...]]:
    out, now = {date(2021, 1, 1): tuple(sorted(_CURRENCIES))}, set(_CURRENCIES)
    for day, more, gone in _CURRENCY_CHANGES:
        now = (now | more) - gone
        out[day] = tuple(sorted(now))
    return out


def _countries() -> dict[date, tuple[str, ...]]:
    """The two-letter codes that the JVM's own table of the standard holds."""
    from pyspark.sql import SparkSession

    codes = SparkSession.active()._jvm.java.util.Locale.getISOCountries()
    return {date(2021, 1, 1): tuple(sorted(codes))}


def register_code_list(name: str, versions: dict[date, tuple[str, ...]]) -> None:
    """Give a list, or another edition of one, by the days from which its versions hold; the JVM's countries say no day of their own."""
    CODE_LISTS[name] = dict(versions)


#: Code lists with the day from which a version holds, or a function that makes them.
CODE_LISTS: dict[str, dict[date, tuple[str, ...]] | Callable[[], dict[date, tuple[str, ...]]]] = {
    "iso4217": _currencies(),
    "iso3166": _countries,
    # Currencies without a minor unit, and sides of a trade.
    "zero_decimal_currencies": {date(2021, 1, 1): tuple("BIF CLP DJF GNF ISK JPY KMF KRW PYG RWF UGX UYI VND VUV XAF XOF XPF".split())},
    "trade_side": {date(2021, 1, 1): ("BUY", "SELL")},
}


def code_list(name: str, as_of: date | None = None) -> tuple[str, ...]:
    """The version of a list that holds on a day; the latest without one."""
    versions = CODE_LISTS[name]
    if callable(versions):
        versions = versions()
    days = [d for d in versions if as_of is None or d <= as_of]
    if not days:
        raise ValueError(f"{name} has no version on {as_of}")
    return versions[max(days)]
