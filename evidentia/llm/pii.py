"""Personal information in free text: found by format and context, replaced by typed placeholders.

Mail and street addresses, phone numbers, identity numbers and names are found by patterns for Chinese, English, French and
German text; 18-character identity numbers must have the right check digit. In the clean text each stands as
[TYPE:pseudonym]. Numbers keep their format: a keyed Feistel network permutes the digits among the numbers of that length, a
birth date, inside an identity number or free in the text, among the dates of its century, and check digits are made
anew. Names and addresses get a keyed code. Equal values thus stay linked across documents, and only the key holder can undo a
number. Every occurrence comes with its pseudonym.

Defined results: NULL and empty texts hold nothing and stay as they are; texts of any length are searched whole; rows that
repeat a key give each occurrence once; other columns are not read.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.frames import Columns, map_rows
from evidentia.session import spread

#: Full-width forms that stand for ASCII in numbers and addresses; one character each, so positions stay.
_WIDE = {0xFF10 + i: 0x30 + i for i in range(10)} | {0xFF0B: "+", 0xFF0D: "-"}
_ANY_WIDE = re.compile("[０-９＋－]")

_AT = re.compile(r"\s?[@＠]\s?|\s?\[at\]\s?|\s?\(at\)\s?")
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z0-9-]+)*(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z]{2,}")

#: A stretch of digits and what may join them, for the exact patterns below.
_NUMBER = re.compile(r"(?<![A-Za-z0-9.+/-])[+(（]{0,2}[0-9][0-9 ()（）./-]{5,26}[0-9Xx]")
_TAIL = re.compile(r"(?:\s?(?:转|分机|ext\.?|Ext\.?|poste|Durchwahl)\s?[0-9]{1,6})?")
_PHONE = [
    re.compile(p)
    for p in (
        r"(?:\+?86[ -]?)?1[3-9][0-9](?P<s>[ -]?)[0-9]{4}(?P=s)[0-9]{4}(?![0-9])",
        r"(?:[(（]0[0-9]{2,3}[)）] ?|0[0-9]{2,3}-)[0-9]{7,8}(?![0-9])",
        r"\+1[ .-](?:[(（][0-9]{3}[)）] ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        r"(?:[(（][0-9]{3}[)）] ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
        r"(?:\+33 ?|0)[1-9](?P<s>[ .-]?)[0-9]{2}(?:(?P=s)[0-9]{2}){3}(?![0-9])",
        r"(?:\+49 ?(?:[(]0[)])?[1-9][0-9]{1,4}|[(]0[1-9][0-9]{1,4}[)]|0[1-9][0-9]{1,4})[ /-]{1,2}[0-9]{3,8}(?:[ -][0-9]{1,5})?(?![0-9])",
        r"(?:\+44 ?(?:[(]0[)])?[1-9][0-9]{1,4}|[(]0[1-9][0-9]{1,4}[)]|0[1-9][0-9]{1,4})(?: [0-9]{3,4}){1,2}(?: ?[0-9]{2,4})?(?![0-9])",
        r"\+[1-9][0-9]{0,2}(?:[ .-]?[(]?[0-9]{1,5}[)]?){2,5}(?![0-9])",
    )
]
_ID18 = re.compile(r"([1-9][0-9]{5})([ -]?)((?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))\2([0-9]{3}[0-9Xx])(?![0-9A-Za-z])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NIR = re.compile(r"[12] [0-9]{2} [0-9]{2} [0-9]{2} [0-9]{3} [0-9]{3}(?: [0-9]{2})?(?![0-9])")
_LETTERED = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]|[A-Z]{2}[0-9]{7}|[EGDS][0-9]{8})(?![A-Za-z0-9])")

_ROAD_ZH = r"[一-鿿]{1,5}?(?:大道|大街|胡同|街|路|弄|巷|道)"
_REST_ZH = r"[0-9]{1,5}号(?:院|楼)?(?:[0-9]{1,4}(?:号院))?(?:[0-9]{1,4}(?:号楼|幢|栋|座|单元))?(?:[0-9]{1,4}(?:单元|层|楼))?(?:[0-9]{1,5}室?)?"
_PART_ZH = r"(?:[一-鿿]{2,3}?(?:街道|镇|乡))?"
_ADDRESS_ZH = re.compile(rf"(?:(?:(?<=住址)|(?<=地址)|(?<=寄至)|(?<=寄往)|(?<=送至)|(?<=住在)|(?<=居住于))[一-鿿]{{2,12}}?(?:新区|市|县|区)|[一-鿿]{{2}}(?:新区|市|县|区)){_PART_ZH}{_ROAD_ZH}{_REST_ZH}|(?:(?<=住址)|(?<=地址)|(?<=寄至)|(?<=寄往)|(?<=送至)|(?<=住在)|(?<=[：:，,])){_PART_ZH}{_ROAD_ZH}{_REST_ZH}")
_ADDRESS_EN = re.compile(
    r"(?<![\w,.])(?:(?:Flat|Apartment|Apt|Unit|Suite|Room) [0-9]{1,4}[A-Z]?, )?[0-9]{1,5}[A-Z]? (?:[A-Z][\w’'-]+ ){1,3}(?:Street|Road|Avenue|Lane|Close|Row|Walk|Drive|Court|Place|Square|Terrace|Way|Gardens|Crescent|Hill|Mews|Quay|Boulevard|Parade)\b"
    r"(?:, [A-Z][\w’'-]+(?: [A-Z][\w’'-]+)?)?(?: [A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}\b)?"
    # Whatever the street is called, a postcode after the town tells.
    r"|(?<![\w,.])(?:(?:Flat|Apartment|Apt|Unit|Suite|Room) [0-9]{1,4}[A-Z]?, )?[0-9]{1,5}[A-Z]? (?:[A-Z][\w’'-]+ ?){1,4}, [A-Z][\w’'-]+(?: [A-Z][\w’'-]+)?,? [A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}\b"
)
_ADDRESS_FR = re.compile(r"(?<![\w,.])[0-9]{1,4}(?: (?:bis|ter|quater))?,? (?:rue|avenue|boulevard|quai|impasse|allée|place|chemin|route|cours|square|passage|sentier|faubourg)\b[^,;:\n]{2,40}?, [0-9]{5} [A-ZÀ-Ý][\w’-]+")
_ADDRESS_DE = re.compile(r"[0-9]{1,4} ?[a-z]?, [0-9]{5} [A-ZÄÖÜ]\w+")
_STREET_DE = re.compile(r"(?:(?:Am|An|Auf|Bei|Im|In|Zum|Zur|Unter|Hinter|Vor) (?:der |den |dem )?)?(?:[A-ZÄÖÜ][\wäöüß.-]+ ){1,3}$")

#: Family names that mark a Chinese name without other context: a fixed list of common and of two-character ones.
SURNAMES_ZH = (
    "欧阳 夏侯 诸葛 闻人 东方 赫连 皇甫 尉迟 公羊 澹台 公冶 宗政 濮阳 淳于 单于 太叔 申屠 公孙 仲孙 轩辕 令狐 钟离 宇文 长孙 慕容 鲜于 闾丘 司徒 司空 司马 上官 南宫 西门 东郭 百里 呼延 端木 独孤 "
    "王 李 张 刘 陈 杨 黄 赵 周 吴 徐 孙 朱 马 胡 郭 林 何 高 梁 郑 罗 宋 谢 唐 韩 曹 许 邓 萧 冯 曾 程 蔡 彭 潘 袁 董 余 苏 叶 吕 魏 蒋 田 杜 丁 沈 姜 范 江 傅 钟 卢 汪 戴 崔 任 陆 廖 姚 方 金 邱 夏 谭 韦 贾 邹 石 熊 孟 秦 阎 薛 侯 雷 白 龙 段 郝 孔 邵 史 毛 常 万 顾 赖 武 康 贺 严 尹 钱 施 牛 洪 龚 "
    "裴 鄢 瞿 骆 褚 冼 晏 霍 柏 宓 桑 郁 蒙 阮 翟 俞 柯 池 靳 岳 戚 蔺 沐 虞 柳 华 殷 庞 樊 兰 章 聂 庄 辛 管 祝 左 涂 谷 祁 时 舒 耿 牟 卜 詹 关 苗 凌 费 纪 盛 童"
).split()
_NAME_ZH = rf"(?:(?:{'|'.join(SURNAMES_ZH)})[一-鿿]{{1,2}})"
_NAMES_ZH = [
    re.compile(r"(?:联系人|来信人|投诉人|申请人|举报人|当事人|经办人|收件人|联络人|代理人|咨询人)[：:]?\s?((?:(?:欧阳|夏侯|闻人|濮阳|钟离|诸葛|司马|司徒|上官|慕容|令狐|皇甫|宇文|长孙|公孙|淳于|尉迟|端木|南宫)[一-鿿]{1,2}?|[一-鿿]{2,3}?))(?=[（(，,；;。、\s]|于|反映|称|来电|来函|同志|先生|女士)"),
    re.compile(rf"(?:回执请交|请交|交由|转交|联系|致电|收件：)({_NAME_ZH})(?=[（(，,；;。、\s])"),
    re.compile(rf"({_NAME_ZH})(?=同志|先生|女士|小姐)"),
    re.compile(rf"(?<=[，,])({_NAME_ZH})(?=(?:亲)?收[。；，])"),
    re.compile(rf"(?:代表|代理人|联系人|申请人|负责人)[为是]({_NAME_ZH})(?=[与和、，,。；])"),
    re.compile(rf"(?<=[与和、])({_NAME_ZH})(?=[，,](?:通讯|住址|地址|联系|电话))"),
    re.compile(rf"({_NAME_ZH})(?=代表.{{0,8}}(?:签字|签名|确认|出席))"),
    re.compile(rf"(?:我叫|我是|本人|姓名(?:为|是)?[：:]?\s?|署名[：:]\s?)({_NAME_ZH})(?=[（(，,；;。、\s]|$)"),
    re.compile(rf"(?:^|(?<=[。；，,\n]))({_NAME_ZH})(?=于[0-9]{{1,4}}[年月]|(?:来电|来信|来函|致电|反映|投诉|举报)(?:称|说|，|：))", re.M),
]
_CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ’'-]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?"
_FULL = rf"{_CAP}(?: (?:[A-Z]\.|{_CAP}|von|van|de|du|der))*? {_CAP}"
_TITLES = r"(?:(?:Drs?|Mrs?|Ms|Miss|Prof|Sir|Frau|Herrn?|Madame|Monsieur|Mme|Mlle|Me|M)\.? )"
_NAMES = [
    re.compile(rf"(?:Contact ?|Kontakt|Ansprechpartner(?:in)?|Attn|Attention): {_TITLES}*({_FULL})(?=[,;.\n]|$)"),
    re.compile(rf"(?<!\w){_TITLES}+({_CAP} (?:[A-Z]\. )?{_CAP})(?!\w)"),
    re.compile(rf"(?:complainant|applicant|claimant|petitioner|witness|informant), {_TITLES}*({_FULL}),"),
    re.compile(rf"(?:ask for|attention of|care of|c/o) {_TITLES}*({_CAP} (?:[A-Z]\. )?{_CAP})(?!\w)"),
    re.compile(rf"\bfor {_TITLES}*({_CAP} (?:[A-Z]\. )?{_CAP})(?= to (?:collect|sign|pick|fetch))"),
    re.compile(rf"(?<!\w)({_CAP} (?:[A-Z]\. )?{_CAP})(?= (?:told|said|wrote|stated|replied|argued|complained|testified|explained|asked|informed|a signé|a déclaré|a écrit|erklärte|schrieb|sagte|unterzeichnete)\b)"),
    re.compile(rf"(?:de|d’|von|by|from) {_TITLES}*({_CAP} (?:[A-Z]\. )?{_CAP})(?=, (?:demeurant|domicilié|wohnhaft|residing|resident|living))"),
    re.compile(rf"(?:[Mm]y name is|I am called|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m’appelle|[Jj]e soussignée?,?|[Nn]ame:|[Nn]om :) {_TITLES}*({_FULL})(?!\w)"),
    re.compile(rf"(?:[Yy]ours (?:sincerely|faithfully|truly)|[Kk]ind regards|[Bb]est regards|[Mm]it freundlichen Grüßen|[Hh]ochachtungsvoll|[Cc]ordialement|[Vv]euillez agréer[^.\n]{{0,80}}),?\s+{_TITLES}*({_FULL})(?=[,;.\n]|\s*$)"),
]
_CUES_ZH = re.compile("人|同志|先生|女士|小姐|收[。；，]|交|联系|致电|代表|我叫|我是|姓名|署名|于[0-9]|来电|来信|来函|反映|投诉|举报")
_CUES = re.compile(r"Contact|Kontakt|Ansprech|Att|Dr|M[rsm]|Prof|Sir|Frau|Herr|M\.|Mlle|Me |ant,|witness|petitioner|ask for|care of|c/o| to | told| said| wrote| stated| replied| argued| complain| testif| explain| asked| informed| a | erklär| schrieb| sagte| unterz|demeurant|domicilié|wohnhaft|resid|living|ame is|called|Name|heiße|appelle|soussign|Nom |Yours|yours|egards|Grüßen|ochacht|ordialement|agréer")


def check_digit(first17: str) -> str:
    """The check digit of an 18-character identity number (ISO 7064 MOD 11-2)."""
    return "10X98765432"[sum(int(d) * pow(2, 17 - i, 11) for i, d in enumerate(first17)) % 11]


def find(text: str) -> list[tuple[int, int, str]]:
    """Start, end and type of each occurrence, by start; they do not overlap."""
    plain = text.translate(_WIDE) if _ANY_WIDE.search(text) else text
    taken: list[tuple[int, int, str]] = []

    def take(start: int, end: int, kind: str) -> None:
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, kind))

    for at in _AT.finditer(plain):
        local = _LOCAL.search(plain, max(0, at.start() - 80), at.start())
        domain = _DOMAIN.match(plain, at.end())
        if local and domain:
            take(local.start(), domain.end(), "email")
    for m in _LETTERED.finditer(plain):
        take(m.start(), m.end(), "id_number")
    for m in _NUMBER.finditer(plain):
        _number(plain, m.start(), m.end(), take)
    if "号" in plain:
        for m in _ADDRESS_ZH.finditer(plain):
            take(m.start(), m.end(), "address")
    for pattern in (_ADDRESS_EN, _ADDRESS_FR):
        for m in pattern.finditer(plain):
            take(m.start(), m.end(), "address")
    for m in _ADDRESS_DE.finditer(plain):
        if street := _STREET_DE.search(plain, max(0, m.start() - 60), m.start()):
            take(street.start(), m.end(), "address")
    names: set[str] = set()
    for pattern in [*(_NAMES_ZH if _CUES_ZH.search(plain) else ()), *(_NAMES if _CUES.search(plain) else ())]:
        for m in pattern.finditer(plain):
            take(m.start(1), m.end(1), "name")
            names.add(m.group(1))
    for name in names:  # a name once introduced is found wherever the document repeats it
        at = plain.find(name)
        while at >= 0:
            if not (name[-1].isascii() and plain[at + len(name) : at + len(name) + 1].isalnum()):
                take(at, at + len(name), "name")
            at = plain.find(name, at + len(name))
    return sorted(taken)


def _number(text: str, start: int, end: int, take) -> None:
    at = start
    while at < end:
        for pattern, kind in ((_ID18, "id_number"), (_SSN, "id_number"), (_NIR, "id_number"), *((p, "phone") for p in _PHONE)):
            m = pattern.match(text, at)
            if not m or kind == "id_number" and text[at - 1 : at].isdigit():
                continue
            if pattern is _ID18 and check_digit(m[1] + m[3] + m[4][:3]) != m[4][3].upper():
                continue
            if kind == "phone" and (text[at - 1 : at] in "+" and at or text[at - 1 : at].isdigit()):
                continue
            stop = _TAIL.match(text, m.end()).end() if kind == "phone" else m.end()
            take(at, stop, kind)
            at = stop - 1
            break
        at += 1


def _round(key: bytes, i: int, half: int, length: int) -> int:
    return int.from_bytes(hashlib.blake2s(b"%d,%d,%d" % (i, length, half), key=key).digest()[:8], "big")


def feistel(digits: str, key: bytes, undo: bool = False) -> str:
    """digits permuted among all digit strings of this length by an alternating Feistel network; undo reverses it."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + (-1 if undo else 1) * _round(key, 0, 0, 1)) % 10) if n else ""
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    sizes = 10**u, 10 ** (n - u)
    for i in reversed(range(10)) if undo else range(10):
        sign = -1 if undo else 1
        if i % 2 == 0:
            a = (a + sign * _round(key, i, b, n)) % sizes[0]
        else:
            b = (b + sign * _round(key, i, a, n)) % sizes[1]
    return f"{a:0{u}d}{b:0{n - u}d}"


def permuted_date(yyyymmdd: str, key: bytes, undo: bool = False) -> str:
    """A date of 1900 to 1999 permuted among those dates, any other among its own century's."""
    try:
        day = datetime.date(int(yyyymmdd[:4]), int(yyyymmdd[4:6]), int(yyyymmdd[6:]))
    except ValueError:
        return yyyymmdd
    first = datetime.date(day.year // 100 * 100, 1, 1)
    span = (datetime.date(first.year + 99, 12, 31) - first).days + 1
    n = (day - first).days
    while True:  # cycle walking: the permutation of 00000 to 99999, until it falls on a day
        n = int(feistel(f"{n:05d}", key, undo))
        if n < span:
            return (first + datetime.timedelta(n)).strftime("%Y%m%d")


#: What introduces a birth date, and its forms: year, month and day in the group order given.
_MONTHS = "January February March April May June July August September October November December janvier février mars avril mai juin juillet août septembre octobre novembre décembre Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
_BORN = r"(?:出生日期(?:为|是)?[：:]?\s?|生日[：:]?\s?|出生于|生于|[Bb]orn (?:on )?|[Dd]ate of birth:? |[Nn]ée? le |[Gg]eboren am )"
_BIRTHS = [
    (re.compile(_BORN + r"((?:19|20)[0-9]{2})([年./-])([0-9]{1,2})([月./-])([0-9]{1,2})(日?)"), "ymd"),
    (re.compile(_BORN + r"([0-9]{1,2})(\. ?|[ ./-])([0-9]{1,2})([ ./-]|\. ?)((?:19|20)[0-9]{2})()"), "dmy"),
    (re.compile(_BORN + rf"([0-9]{{1,2}})(\. |er | )({'|'.join(dict.fromkeys(_MONTHS))})( )((?:19|20)[0-9]{{2}})()"), "dny"),
]


def births_permuted(text: str, key: bytes) -> str:
    """The text with every introduced birth date permuted among the dates of its century, written as it was."""
    for pattern, order in _BIRTHS:

        def new(m: re.Match[str], order: str = order) -> str:
            year, month, day = (m[1], m[3], m[5]) if order == "ymd" else (m[5], m[3], m[1])
            names = [x for i in range(0, 36, 12) if month in (x := _MONTHS[i : i + 12])] if order == "dny" else []
            number = names[0].index(month) + 1 if names else int(month)
            old = f"{year}{number:02d}{int(day):02d}"
            got = permuted_date(old, key)
            if got == old:
                return m[0]
            width = lambda was, now: f"{int(now):02d}" if len(was) == 2 else str(int(now))
            said = names[0][int(got[4:6]) - 1] if names else width(month, got[4:6])
            parts = (got[:4], said, width(day, got[6:])) if order == "ymd" else (width(day, got[6:]), said, got[:4])
            return m[0][: m.start(1) - m.start()] + parts[0] + m[2] + parts[1] + m[4] + parts[2] + m[6]

        text = pattern.sub(new, text)
    return text


def nir_key(first13: str) -> str:
    """The key of a French insurance number: 97 less the rest of the first 13 digits by 97."""
    return f"{97 - int(first13) % 97:02d}"


def pseudonym(value: str, kind: str, key: bytes) -> str:
    plain = value.translate(_WIDE)
    if kind == "id_number" and (m := _ID18.fullmatch(plain)):
        body = feistel(m[1], key) + permuted_date(m[3], key) + feistel(m[4][:3], key)
        return f"{body[:6]}{m[2]}{body[6:14]}{m[2]}{body[14:]}{check_digit(body)}"
    if kind in ("id_number", "phone"):
        tail = re.search(r"(?:转|分机|ext\.?|Ext\.?|poste|Durchwahl)", plain)
        body, rest = (plain[: tail.start()], plain[tail.start() :]) if tail else (plain, "")
        lead = re.match(r"\+[0-9]{1,2}(?![0-9])|", body).group()
        given = "".join(c for c in body[len(lead) :] if c.isdigit())
        if kind == "id_number" and len(given) == 15 and _NIR.fullmatch(plain):
            same = feistel(given[1:13], key)  # the first digit, 1 or 2, stays
            digits = iter(given[0] + same + nir_key(given[0] + same))
        else:
            digits = iter(feistel(given, key))
        return lead + "".join(next(digits) if c.isdigit() else c for c in body[len(lead) :]) + rest
    same = re.sub(r"\s", "", plain).lower().replace("＠", "@").replace("[at]", "@").replace("[dot]", ".")
    return hashlib.blake2s(same.encode("utf-8", "surrogatepass"), key=key).hexdigest()[:10]


def redact(text: str, key: bytes) -> str:
    out, last = [], 0
    for start, end, kind in find(text):
        out += [births_permuted(text[last:start], key), f"[{kind.upper()}:{pseudonym(text[start:end], kind, key)}]"]
        last = end
    return "".join([*out, births_permuted(text[last:], key)])


def _docs(df: DataFrame, key: str, text: str) -> DataFrame:
    return spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))


def occurrences(df: DataFrame, key: str = "doc_id", text: str = "text", secret: str = "") -> DataFrame:
    """key, start_pos (counted from 1), end_pos (inclusive), pii_type and pseudonym of every occurrence; `secret` keys the pseudonyms."""
    docs, own = _docs(df, key, text).where("k is not null and t <> ''"), hashlib.sha256(secret.encode()).digest()

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, t in zip(b["k"], b["t"], strict=True):
                for start, end, kind in find(t):
                    yield k, start + 1, end, kind, pseudonym(t[start:end], kind, own)

    return map_rows(docs, run, f"`{key}` {dict(docs.dtypes)['k']}, start_pos long, end_pos long, pii_type string, pseudonym string").distinct()


def redacted(df: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the text with placeholders; `secret` keys the pseudonyms."""
    docs, own = _docs(df, key, text), hashlib.sha256(secret.encode()).digest()

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, t in zip(b["k"], b["t"], strict=True):
                yield k, t and redact(t, own)

    return map_rows(docs, run, f"`{key}` {dict(docs.dtypes)['k']}, `{text}` string")
