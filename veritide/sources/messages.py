"""Financial messages as columns: small expressions over Spark's own text, XML and binary functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col

#: Names of common tags.
FIX_TAGS = {"8": "begin_string", "35": "message_type", "49": "sender", "56": "target", "34": "sequence", "11": "order_id", "55": "symbol", "54": "side", "38": "quantity", "44": "price", "60": "transact_time", "10": "checksum"}


def fix_map(message, delimiter: str = "\x01") -> Column:
    """Tag-value map; of a repeated tag the last value stays."""
    pairs = F.filter(F.split(col(message), delimiter), lambda p: p.contains("="))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v")))
    last = F.aggregate(
        entries, F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])),
    )
    return last


def fix(df: DataFrame, message: str, delimiter: str = "\x01") -> DataFrame:
    """Adds the common fields of FIX messages and whether the checksum holds."""
    out = df.withColumn("__m", fix_map(message, delimiter))
    out = out.select(*df.columns, *[F.try_element_at("__m", F.lit(t)).alias(n) for t, n in FIX_TAGS.items()])
    body = F.regexp_replace(F.regexp_extract(message, rf"^(.*?)10=[0-9]{{3}}{delimiter}?$", 1), delimiter, "\x01")
    total = F.aggregate(F.split(body, ""), F.lit(0), lambda s, c: (s + F.ascii(c)) % 256)
    return out.withColumn("checksum_ok", F.coalesce(F.col("checksum") == F.lpad(total.cast("string"), 3, "0"), F.lit(False)))


def swift_mt(df: DataFrame, message: str) -> DataFrame:
    """Adds fields (array of tag, value) of block 4, the message type and the sender."""
    block = F.regexp_extract(message, r"(?s)\{4:\s*(.*?)-\}", 1)
    tag = r"(?s)(?:^|\n):([0-9]{2}[A-Z]?):(.*?)(?=\n:[0-9]{2}[A-Z]?:|\n?$)"
    fields = F.arrays_zip(F.regexp_extract_all(block, F.lit(tag), 1).alias("tag"), F.transform(F.regexp_extract_all(block, F.lit(tag), 2), lambda x: F.trim(x)).alias("value"))
    kind = F.regexp_extract(message, r"\{2:[IO]([0-9]{3})", 1)
    return df.withColumns({"mt": kind, "sender": F.regexp_extract(message, r"\{1:[A-Z][0-9]{2}([A-Z0-9]{8})", 1), "fields": fields})


def xml_value(document, path: str) -> Column:
    """Text at an XPath; namespaces are taken off first."""
    bare = F.regexp_replace(F.regexp_replace(col(document), r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    return F.nullif(F.xpath_string(bare, F.lit(path)), F.lit(""))


def pacs008(df: DataFrame, document: str) -> DataFrame:
    """Adds the first transfer of an ISO 20022 credit transfer: ids, amount, currency, parties."""
    p = "//CdtTrfTxInf[1]/"
    return df.withColumns({
        "end_to_end_id": xml_value(document, p + "PmtId/EndToEndId"), "amount": xml_value(document, p + "IntrBkSttlmAmt").try_cast("decimal(38,6)"),
        "currency": xml_value(document, p + "IntrBkSttlmAmt/@Ccy"), "debtor": xml_value(document, p + "Dbtr/Nm"), "creditor": xml_value(document, p + "Cdtr/Nm"),
    })


def camt053(df: DataFrame, document: str) -> DataFrame:
    """One row per entry of an ISO 20022 statement: amount and direction."""
    bare = F.regexp_replace(F.regexp_replace(col(document), r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    entries = F.arrays_zip(F.xpath(bare, F.lit("//Ntry/Amt/text()")).alias("amount"), F.xpath(bare, F.lit("//Ntry/CdtDbtInd/text()")).alias("direction"))
    return df.select(*df.columns, xml_value(document, "//Stmt[1]/Id").alias("statement"), F.inline(entries))


def fpml_trade(df: DataFrame, document: str) -> DataFrame:
    """Adds trade date, id and first notional of an FpML trade."""
    return df.withColumns({
        "trade_date": xml_value(document, "//tradeHeader/tradeDate").try_cast("date"), "trade_id": xml_value(document, "//tradeHeader/partyTradeIdentifier[1]/tradeId"),
        "notional": xml_value(document, "//notionalStepSchedule[1]/initialValue").try_cast("decimal(38,6)"), "currency": xml_value(document, "//notionalStepSchedule[1]/currency"),
    })


def iso8583_header(df: DataFrame, message: str) -> DataFrame:
    """Adds the message type and the numbers of the data elements that the bitmaps mark as present.

    Element 1 says that a second bitmap follows the first; it holds no field.
    """
    def marked(at: int) -> Column:
        bits = F.lpad(F.conv(F.substring(message, at, 16), 16, 2), 64, "0")
        return F.filter(F.sequence(F.lit(1), F.lit(64)), lambda i: F.substring(bits, i, F.lit(1)) == "1")

    first = marked(5)
    second = F.when(F.array_contains(first, 1), F.transform(marked(21), lambda i: i + 64)).otherwise(F.array().cast("array<int>"))
    return df.withColumns({"mti": F.substring(message, 1, 4), "elements": F.concat(first, second)})


def packed_decimal(raw, scale: int = 0) -> Column:
    """A COMP-3 field: two digits a byte, the last half byte the sign (C, F plus, D minus); null where it is none."""
    h = F.hex(col(raw))
    digits, s = F.left(h, F.length(h) - 1), F.right(h, F.lit(1))
    number = F.concat(F.when(s == "D", "-").otherwise(""), digits).try_cast("decimal(31,0)")
    return F.when(h.rlike("^[0-9]+[CDF]$"), (number / F.lit(10**scale).cast("decimal(20,0)")).cast(f"decimal(31,{scale})"))


def decode_bytes(raw: Column, charset: str) -> Column:
    """Text of a one-byte character set that Spark doesn't decode itself, such as an EBCDIC code page."""
    plain = bytes(range(1, 256))
    pairs = [(a, b) for a, b in zip(plain.decode("iso-8859-1"), plain.decode(charset), strict=True) if a != b]
    return F.translate(F.decode(raw, "iso-8859-1"), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def binary_number(raw, signed: bool = True, scale: int = 0) -> Column:
    """A COMP or BINARY field of up to eight bytes, the most significant first, in two's complement if ``signed``."""
    c = col(raw)
    number = F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")
    span = F.get(F.array(*[F.lit(str(1 << 8 * n)).cast("decimal(20,0)") for n in range(9)]), F.length(c))
    value = F.when(F.hex(c).rlike("^[89A-F]"), number - span).otherwise(number) if signed else number
    return (value / F.lit(10**scale).cast("decimal(20,0)")).cast(f"decimal(31,{scale})")


def fixed_width(df: DataFrame, raw: str, layout: list[tuple[str, int, int, str]], charset: str = "cp037") -> DataFrame:
    """Fields (name, 1-based start, bytes, kind) of a binary record; kind is text, zoned, zoned:scale, packed:scale, binary:scale or unsigned:scale."""
    out = {}
    for name, start, size, kind in layout:
        part = F.substring(raw, start, size)
        if kind == "text":
            out[name] = F.trim(decode_bytes(part, charset))
        elif kind.partition(":")[0] == "zoned":
            text, scale = F.hex(part), int(kind.partition(":")[2] or 0)
            digits = F.regexp_replace(text, "[0-9A-F]([0-9])", "$1")
            signed = F.concat(F.when(F.substring(text, -2, 1) == "D", "-").otherwise(""), digits)
            number = signed.try_cast("long") if not scale else (signed.try_cast("decimal(31,0)") / F.lit(10**scale).cast("decimal(20,0)")).cast(f"decimal(31,{scale})")
            out[name] = F.when(text.rlike("^(F[0-9])*[CDF][0-9]$"), number)
        elif kind.partition(":")[0] in ("binary", "unsigned"):
            out[name] = binary_number(part, kind.startswith("binary"), int(kind.partition(":")[2] or 0))
        else:
            out[name] = packed_decimal(part, int(kind.partition(":")[2] or 0))
    return df.withColumns(out)


#: Fixed values: (name, digits of the length prefix or 0, length) of data elements.
ISO8583_ELEMENTS = {
    2: ("pan", 2, 19), 3: ("processing_code", 0, 6), 4: ("amount", 0, 12), 5: ("settlement_amount", 0, 12), 6: ("billing_amount", 0, 12), 7: ("transmitted", 0, 10), 8: ("billing_fee", 0, 8),
    9: ("settlement_rate", 0, 8), 10: ("billing_rate", 0, 8), 11: ("trace", 0, 6), 12: ("local_time", 0, 6), 13: ("local_date", 0, 4), 14: ("expiry", 0, 4), 15: ("settlement_date", 0, 4),
    16: ("conversion_date", 0, 4), 17: ("capture_date", 0, 4), 18: ("merchant_type", 0, 4), 19: ("acquirer_country", 0, 3), 20: ("pan_country", 0, 3), 21: ("forwarder_country", 0, 3),
    22: ("entry_mode", 0, 3), 23: ("pan_sequence", 0, 3), 24: ("network", 0, 3), 25: ("condition", 0, 2), 26: ("capture_code", 0, 2), 27: ("authorisation_length", 0, 1), 28: ("transaction_fee", 0, 9),
    29: ("settlement_fee", 0, 9), 30: ("processing_fee", 0, 9), 31: ("settlement_processing_fee", 0, 9), 32: ("acquirer", 2, 11), 33: ("forwarder", 2, 11), 34: ("pan_extended", 2, 28),
    35: ("track2", 2, 37), 36: ("track3", 3, 104), 37: ("reference", 0, 12), 38: ("approval", 0, 6), 39: ("response", 0, 2), 40: ("restriction", 0, 3), 41: ("terminal", 0, 8), 42: ("merchant", 0, 15),
    43: ("place", 0, 40), 44: ("response_data", 2, 25), 45: ("track1", 2, 76), 46: ("additional_iso", 3, 999), 47: ("additional_national", 3, 999), 48: ("additional_private", 3, 999),
    49: ("currency", 0, 3), 50: ("settlement_currency", 0, 3), 51: ("billing_currency", 0, 3), 52: ("pin", 0, 16), 53: ("security", 0, 16), 54: ("additional_amounts", 3, 120),
    64: ("mac", 0, 16), 66: ("settlement_code", 0, 1), 67: ("extended_payment", 0, 2), 68: ("receiver_country", 0, 3), 69: ("settlement_country", 0, 3), 70: ("network_code", 0, 3),
    71: ("message_number", 0, 4), 72: ("last_message_number", 0, 4), 73: ("action_date", 0, 6), 90: ("original", 0, 42), 91: ("file_update", 0, 1), 95: ("replacement_amounts", 0, 42),
    97: ("net_settlement", 0, 17), 98: ("payee", 0, 25), 99: ("settlement_institution", 2, 11), 100: ("receiver", 2, 11), 101: ("file_name", 2, 17), 102: ("account_from", 2, 28), 103: ("account_to", 2, 28),
    104: ("description", 3, 100), 128: ("mac_extended", 0, 16),
    **{i: (f"reserved_{i}", 3, 999) for i in (*range(55, 64), *range(105, 128))}, **{i: (f"count_{i}", 0, 10) for i in range(74, 82)},
    **{i: (f"fee_{i}", 0, 12) for i in range(82, 86)}, **{i: (f"total_{i}", 0, 16) for i in range(86, 90)},
}


def iso8583_fields(df: DataFrame, message: str) -> DataFrame:
    """Adds mti, fields (element number to value) and stopped_at of text messages, in order of their bitmaps.

    Reading stops at an element that isn't known, is longer than it may be, or
    reaches past the end, whose number is then in ``stopped_at``: what follows
    would be read from the wrong place.
    """
    head = iso8583_header(df, message)
    spec = lambda i: F.create_map(*[F.lit(x) for k, v in ISO8583_ELEMENTS.items() for x in (k, v[i])])
    start = F.struct(F.when(F.substring(message, 5, 1).isin(*"89ABCDEFabcdef"), 37).otherwise(21).alias("at"), F.create_map().cast("map<int,string>").alias("m"), F.lit(None).cast("int").alias("stop"))

    def step(acc: Column, e: Column) -> Column:
        prefix, width = F.try_element_at(spec(1), e), F.try_element_at(spec(2), e)
        size = F.when(prefix > 0, F.substring(F.col(message), acc["at"], prefix).try_cast("int")).otherwise(width)
        value = F.substring(F.col(message), acc["at"] + prefix, size)
        known = acc["stop"].isNull() & prefix.isNotNull() & size.isNotNull() & (size <= width) & (F.length(value) == size)
        read = F.struct((acc["at"] + prefix + size).alias("at"), F.map_concat(acc["m"], F.create_map(e, value)).alias("m"), acc["stop"].alias("stop"))
        return F.when(known, read).otherwise(F.struct(acc["at"].alias("at"), acc["m"].alias("m"), F.coalesce(acc["stop"], e).alias("stop")))

    walked = F.aggregate(F.filter("elements", lambda e: e > 1), start, step)
    return head.withColumn("__w", walked).select(*df.columns, "mti", F.col("__w.m").alias("fields"), F.col("__w.stop").alias("stopped_at"))


_ITEM = re.compile(r"^\s*(\d\d)\s+([A-Z0-9-]+)(.*?)\.?\s*$", re.IGNORECASE)


def copybook(text: str) -> list[tuple[str, int, int, str]]:
    """The layout for fixed_width() that a record description gives: (name, start, bytes, kind) of each elementary item.

    Groups hold their items; OCCURS repeats an item or a group, with the place
    behind the name; REDEFINES starts at the item that it names and moves nothing
    on.  A picture that can't be read raises, as all that follows would shift.
    """
    rows = [m.groups() for line in text.splitlines() if not line.lstrip().startswith("*") and (m := _ITEM.match(line))]
    rows = [(int(level), name, rest.upper()) for level, name, rest in rows if level not in ("88", "66")]

    def width(rest: str) -> tuple[int, str]:
        pic = re.search(r"\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)", rest)[1].rstrip(".")
        flat = re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), pic)
        if set(flat) <= {"X"} or set(flat) <= {"A"}:
            return len(flat), "text"
        if not re.fullmatch(r"S?9*V?9*", flat):
            raise ValueError(f"the picture {pic} can't be read")
        digits, scale = flat.count("9"), len(flat.partition("V")[2])
        if re.search(r"\b(COMP-3|COMPUTATIONAL-3|PACKED-DECIMAL)\b", rest):
            return digits // 2 + 1, f"packed:{scale}"
        if re.search(r"\b(COMP-[125]|COMPUTATIONAL-[125]|SIGN)\b", rest) or digits > 18:
            raise ValueError(f"the item {pic} is stored in a way that isn't read")
        if re.search(r"\b(COMP|BINARY|COMPUTATIONAL|COMP-4)\b", rest):
            return 2 if digits < 5 else 4 if digits < 10 else 8, f"{'binary' if pic.startswith('S') else 'unsigned'}:{scale}"
        return digits, f"zoned:{scale}" if scale else "zoned"

    def place(i: int, end: int, start: int, suffix: str, known: dict) -> tuple[list, int]:
        """Items i..end laid out from ``start``: (fields, the place after them)."""
        out, at = [], start
        while i < end:
            level, name, rest = rows[i]
            j = i + 1
            while j < end and rows[j][0] > level:
                j += 1
            times = int(m[1]) if (m := re.search(r"\bOCCURS\s+(\d+)", rest)) else 1
            over = re.search(r"\bREDEFINES\s+([A-Z0-9-]+)", rest)
            if over and over[1].upper() not in known:
                raise ValueError(f"{name} redefines {over[1]}, which stands nowhere above it")
            here = known[over[1].upper()] if over else at
            known[name.upper()] = here
            for k in range(times):
                tail = suffix + (f"_{k + 1}" if times > 1 else "")
                if "PIC" in rest:
                    size, kind = width(rest)
                    out.append((name.lower().replace("-", "_") + tail, here, size, kind))
                    here += size
                else:
                    inner, here = place(i + 1, j, here, tail, known)
                    out += inner
            at = at if over else here
            i = j
        return out, at

    return place(0, len(rows), 1, "", {})[0]
