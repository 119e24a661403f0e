"""Number formats of spreadsheets: what a cell shows for a value."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from functools import lru_cache

# The formats that a number stands for in a file.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "hh:mm", 21: "hh:mm:ss", 22: "m/d/yy hh:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[red](#,##0)", 39: "#,##0.00 ;(#,##0.00)", 40: "#,##0.00 ;[red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

_TOKEN = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|AM/PM|A/P|E[+-]|General|[yY]+|[mM]+|[dD]+|[hH]+|[sS]+(?:\.0+)?|[0#?]+|.', re.S | re.I)
_DATE = re.compile(r"^(?:[ymdhs]+(?:\.0+)?|AM/PM|A/P|\[[hms]+\])$", re.I)


@lru_cache(4096)
def sections(code: str) -> list[list[str]]:
    """Tokens of a format's sections: positive, negative, zero, text."""
    out: list[list[str]] = [[]]
    for token in _TOKEN.findall(code):
        if token == ";":
            out.append([])
        else:
            out[-1].append(token)
    return out


def _literal(token: str) -> str:
    if token[0] == '"':
        return token[1:-1]
    if token[0] == "\\":
        return token[1:]
    if token[0] == "_":
        return " "
    if token[0] == "*":
        return ""
    if token[0] == "[":
        found = re.match(r"\[\$([^\]-]*)", token)
        return found[1] if found else ""
    return token


def general(value: Decimal) -> str:
    """Up to 15 significant digits, an exponent from 1E+21 or below 1E-9 on."""
    if value == 0:
        return "0"
    value = value.normalize() if len(value.as_tuple().digits) <= 15 else Decimal(f"{value:.14E}").normalize()
    size = value.adjusted()
    if size >= 21 or size < -9:
        digits, _, exponent = f"{value:E}".partition("E")
        return f"{digits}E{'+' if int(exponent) >= 0 else '-'}{abs(int(exponent)):02d}"
    return f"{value:f}"


def shown(raw: str, code: str, epoch_1904: bool = False) -> str:
    """What a numeric cell shows; a value that is no number is shown as it is."""
    try:
        value = Decimal(raw)
    except InvalidOperation:
        return raw
    if not value.is_finite():
        return raw
    parts = sections(code)
    numeric = parts[:3]
    k = 1 if value < 0 and len(numeric) > 1 else 2 if value == 0 and len(numeric) > 2 else 0
    tokens = numeric[k]
    if not tokens and code:
        return ""
    if any(t.lower() == "general" for t in tokens) or code in ("", "@"):
        return "".join(general(value) if t.lower() == "general" or t == "@" else _literal(t) for t in tokens) or general(value)
    if any(_DATE.match(t) for t in tokens):
        return _dated(value, tokens, epoch_1904)
    sign = "-" if value < 0 and k == 0 else ""
    return sign + _numbered(abs(value), tokens)


def _numbered(value: Decimal, tokens: list[str]) -> str:
    if "/" in tokens and sum(bool(re.fullmatch("[0#?]+", t)) for t in tokens) >= 2:
        return _fraction(value, tokens)
    value = value.scaleb(2 * sum(t == "%" for t in tokens))
    spots = [k for k, t in enumerate(tokens) if re.fullmatch("[0#?]+", t)]
    if not spots:
        return "".join(_literal(t) for t in tokens)
    exponent = next((k for k, t in enumerate(tokens) if re.fullmatch(r"E[+-]", t, re.I)), None)
    point = next((k for k, t in enumerate(tokens) if t == "." and (exponent is None or k < exponent)), None)
    whole = [k for k in spots if (point is None or k < point) and (exponent is None or k < exponent)]
    after = [k for k in spots if point is not None and k > point and (exponent is None or k < exponent)]
    last = max(whole + after, default=spots[-1])
    trailing = 0
    while last + 1 + trailing < len(tokens) and tokens[last + 1 + trailing] == ",":
        trailing += 1
    value = value.scaleb(-3 * trailing)
    grouped = any(t == "," for t in tokens[min(spots) : max(whole, default=0)])
    places = sum(len(tokens[k]) for k in after)
    power = 0
    if exponent is not None and value:
        width = max(1, sum(len(tokens[k]) for k in whole))
        power = value.adjusted() - (value.adjusted() % width if width > 1 else 0)
        value = value.scaleb(-power)
    text = f"{value.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):f}"
    digits, _, fraction = text.partition(".")
    least = sum(t == "0" for k in whole for t in tokens[k])
    digits = digits.lstrip("0").rjust(least, "0") if least or digits.strip("0") == "" else digits
    if grouped:
        digits = re.sub(r"(?<=\d)(?=(?:\d{3})+$)", ",", digits)
    optional = "".join(tokens[k] for k in after)
    while fraction and fraction[-1] == "0" and optional[len(fraction) - 1] == "#":
        fraction = fraction[:-1]
    out, done = [], False
    for k, t in enumerate(tokens):
        if k in whole:
            out.append("" if done else digits)
            done = True
        elif k == point:
            out.append(("" if done else digits) + ".")
            done = True
        elif k in after:
            out.append(fraction[: len(t)])
            fraction = fraction[len(t) :]
        elif k == exponent:
            out.append(f"E{'-' if power < 0 else '+' if t[1] == '+' else ''}")
        elif k in spots:
            out.append(str(abs(power)).rjust(sum(c == "0" for c in t), "0"))
        elif t == "," and (spots[0] < k <= last + trailing):
            continue
        else:
            out.append(_literal(t))
    return "".join(out)


def _fraction(value: Decimal, tokens: list[str]) -> str:
    slash = tokens.index("/")
    below = next(t for t in tokens[slash + 1 :] if re.fullmatch("[0#?]+", t))
    mixed = sum(bool(re.fullmatch("[0#?]+", t)) for t in tokens[:slash]) > 1
    whole, rest = divmod(value, 1) if mixed else (Decimal(0), value)
    n, d = rest.as_integer_ratio() if rest else (0, 1)
    from fractions import Fraction

    best = Fraction(n, d).limit_denominator(10 ** len(below) - 1)
    if mixed and best == 1:
        whole, best = whole + 1, Fraction(0)
    shown_whole = str(int(whole)) if whole or not best else ""
    part = f"{best.numerator}/{best.denominator}" if best else ""
    return " ".join(x for x in (shown_whole, part) if x) if mixed else f"{best.numerator}/{best.denominator}"


def _dated(value: Decimal, tokens: list[str], epoch_1904: bool) -> str:
    if value < 0 or value > 2958466:
        return general(value)
    exact = next((len(t) - t.index(".") - 1 for t in tokens if re.match(r"s+\.0", t, re.I)), 0)
    seconds = (value * 86400).quantize(Decimal(1).scaleb(-exact), ROUND_HALF_UP)
    # Day 60 of the 1900 system is a 29 February that never was.
    days = int(seconds // 86400)
    start = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 31) if days < 60 else datetime(1899, 12, 30)
    when = start + timedelta(seconds=float(seconds))
    half = any(t.upper() in ("AM/PM", "A/P") for t in tokens)
    kinds = [t.lower() if _DATE.match(t) else "" for t in tokens]
    out = []
    for k, t in enumerate(tokens):
        kind = kinds[k]
        if not kind:
            out.append(_literal(t))
        elif kind in ("am/pm", "a/p"):
            out.append(kind.upper().split("/")[when.hour >= 12])
        elif kind[0] == "[":
            total = int(seconds // {"h": 3600, "m": 60, "s": 1}[kind[1]])
            out.append(str(total).rjust(len(kind) - 2, "0"))
        elif kind[0] == "y":
            out.append(f"{when.year:04d}" if len(kind) > 2 else f"{when.year % 100:02d}")
        elif kind[0] == "d":
            name = DAYS[when.weekday()]
            out.append(name if len(kind) > 3 else name[:3] if len(kind) == 3 else f"{when.day:0{len(kind)}d}")
        elif kind[0] == "h":
            hour = (when.hour % 12 or 12) if half else when.hour
            out.append(f"{hour:0{min(len(kind), 2)}d}")
        elif kind[0] == "s":
            whole, _, part = kind.partition(".")
            fraction = f"{seconds % 1:.{len(part)}f}"[1:] if part else ""
            out.append(f"{when.second:0{min(len(whole), 2)}d}{fraction}")
        else:
            before = next((x for x in reversed(kinds[:k]) if x and x not in ("am/pm", "a/p")), "")
            behind = next((x for x in kinds[k + 1 :] if x), "")
            if before[:1] in ("h",) or before[:2] == "[h" or behind[:1] == "s":
                out.append(f"{when.minute:0{min(len(kind), 2)}d}")
            else:
                name = MONTHS[when.month - 1]
                out.append(name[0] if len(kind) == 5 else name if len(kind) == 4 else name[:3] if len(kind) == 3 else f"{when.month:0{len(kind)}d}")
    return "".join(out)
