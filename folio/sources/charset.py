"""Bytes to text: byte order marks, declared charsets and their labels, and what is left undecodable."""

from __future__ import annotations

import codecs
import re

# Byte order marks, the longer before the shorter that they begin with, and their codecs.
MARKS = (
    (b"\xef\xbb\xbf", "utf-8"),
    (b"\xff\xfe\x00\x00", "utf-32-le"),
    (b"\x00\x00\xfe\xff", "utf-32-be"),
    (b"\xff\xfe", "utf-16-le"),
    (b"\xfe\xff", "utf-16-be"),
)

# Labels of the WHATWG Encoding Standard whose codec has another name here, or that mean a superset.
LABELS = {
    "ascii": "cp1252",
    "us-ascii": "cp1252",
    "latin1": "cp1252",
    "iso-8859-1": "cp1252",
    "iso8859-1": "cp1252",
    "iso88591": "cp1252",
    "iso_8859-1": "cp1252",
    "l1": "cp1252",
    "windows-1252": "cp1252",
    "x-cp1252": "cp1252",
    "iso-8859-9": "cp1254",
    "iso8859-9": "cp1254",
    "latin5": "cp1254",
    "iso-8859-11": "cp874",
    "tis-620": "cp874",
    "windows-874": "cp874",
    "dos-874": "cp874",
    "iso-8859-8-i": "iso8859-8",
    "logical": "iso8859-8",
    "visual": "iso8859-8",
    "unicode-1-1-utf-8": "utf-8",
    "unicode11utf8": "utf-8",
    "unicode20utf8": "utf-8",
    "x-unicode20utf8": "utf-8",
    "utf8": "utf-8",
    "utf-8": "utf-8",
    "utf-16": "utf-16-le",
    "utf-16le": "utf-16-le",
    "utf-16be": "utf-16-be",
    "unicode": "utf-16-le",
    "unicodefeff": "utf-16-le",
    "unicodefffe": "utf-16-be",
    "ucs-2": "utf-16-le",
    "iso-10646-ucs-2": "utf-16-le",
    "csunicode": "utf-16-le",
    "gb2312": "gb18030",
    "gb_2312": "gb18030",
    "gb_2312-80": "gb18030",
    "csgb2312": "gb18030",
    "chinese": "gb18030",
    "csiso58gb231280": "gb18030",
    "iso-ir-58": "gb18030",
    "gbk": "gb18030",
    "x-gbk": "gb18030",
    "gb18030": "gb18030",
    "big5": "big5hkscs",
    "big5-hkscs": "big5hkscs",
    "cn-big5": "big5hkscs",
    "csbig5": "big5hkscs",
    "x-x-big5": "big5hkscs",
    "euc-jp": "euc_jp",
    "x-euc-jp": "euc_jp",
    "cseucpkdfmtjapanese": "euc_jp",
    "iso-2022-jp": "iso2022_jp",
    "csiso2022jp": "iso2022_jp",
    "shift_jis": "cp932",
    "shift-jis": "cp932",
    "sjis": "cp932",
    "x-sjis": "cp932",
    "ms_kanji": "cp932",
    "ms932": "cp932",
    "windows-31j": "cp932",
    "csshiftjis": "cp932",
    "euc-kr": "cp949",
    "korean": "cp949",
    "ks_c_5601-1987": "cp949",
    "ks_c_5601-1989": "cp949",
    "ksc5601": "cp949",
    "ksc_5601": "cp949",
    "iso-ir-149": "cp949",
    "cseuckr": "cp949",
    "csksc56011987": "cp949",
    "windows-949": "cp949",
    "macintosh": "mac_roman",
    "mac": "mac_roman",
    "x-mac-roman": "mac_roman",
    "csmacintosh": "mac_roman",
    "x-mac-cyrillic": "mac_cyrillic",
    "x-mac-ukrainian": "mac_cyrillic",
    "cp866": "cp866",
    "866": "cp866",
    "ibm866": "cp866",
    "csibm866": "cp866",
    "koi8-r": "koi8_r",
    "koi8": "koi8_r",
    "koi": "koi8_r",
    "koi8_r": "koi8_r",
    "cskoi8r": "koi8_r",
    "koi8-u": "koi8_u",
    "koi8-ru": "koi8_u",
}
#: Windows code pages and the other parts of ISO 8859 go by a rule.
_FAMILIES = ((re.compile(r"(?:windows-|x-cp|cp)(125[0-8])$"), "cp{}"), (re.compile(r"iso[-_]?8859[-_]?(2|3|4|5|6|7|8|10|13|14|15|16)$"), "iso8859-{}"))


def codec_of(label: str | None) -> str | None:
    """The codec that a charset label names, white space and quotes around it ignored; None if it is unknown or stands for no real encoding."""
    bare = (label or "").strip().strip("\"'").strip().lower()
    if bare in LABELS:
        return LABELS[bare]
    for pattern, name in _FAMILIES:
        if found := pattern.match(bare):
            return name.format(found[1])
    return None


def decoded(data: bytes, codec: str) -> str:
    """Text in which every run of bytes that cannot be decoded is one U+FFFD."""
    if codec == "utf-8":
        return _utf8(data)
    return codecs.decode(data, codec, "replace")


def _utf8(data: bytes) -> str:
    return re.sub("[\udc80-\udcff]+", "\ufffd", data.decode("utf-8", "surrogateescape"))


def decode(data: bytes, declared: str | None = None, fallback: str | None = None) -> str:
    """A text: a byte order mark decides, then a known declared charset, then UTF-8 if it is valid, then the fallback, then UTF-8."""
    for mark, codec in MARKS:
        if data.startswith(mark):
            return decoded(data[len(mark) :], codec)
    if codec := codec_of(declared):
        return decoded(data, codec)
    try:
        return data.decode()
    except UnicodeDecodeError:
        return decoded(data, codec_of(fallback) or "utf-8")


def normalized(text: str) -> str:
    """Without one leading byte order mark and without NUL, lines ended by LF."""
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
