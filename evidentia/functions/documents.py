"""Document numbers, issuers and the completeness of a body, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import WS

#: The forms of document numbers, in order of preference.
DOCNOS = [
    rf"[\x{{4e00}}-\x{{9fa5}}]{{1,12}}(?:发|办|函|公告|令|规|字|号)?{WS}*[〔\[（(【]{WS}*20[0-9]{{2}}{WS}*[〕\]）)】]{WS}*[0-9]{{1,4}}{WS}*号",
    rf"[\x{{4e00}}-\x{{9fa5}}]{{2,20}}令{WS}*(?:第{WS}*)?[0-9]{{1,4}}{WS}*号",
    rf"[\x{{4e00}}-\x{{9fa5}}]{{2,20}}(?:公告|通知){WS}*(?:第{WS}*)?20[0-9]{{2}}{WS}*年{WS}*第?{WS}*[0-9]{{1,4}}{WS}*号",
    rf"\b[0-9]{{2,3}}{WS}+FR{WS}+[0-9]{{3,6}}\b",
    rf"(?i)\b(?:Regulation|Directive|Decision){WS}*\((?:EU|EC|EEC)\){WS}*[0-9]{{4}}/[0-9]{{1,5}}\b",
    rf"\b(?:EU|EC){WS}*(?:No\.?)?{WS}*[0-9]{{4}}/[0-9]{{1,5}}\b",
    rf"\bSI{WS}+[0-9]{{4}}/[0-9]{{1,4}}\b",
]
#: Labels and endings of issuers.
ISSUER_LABEL = rf"(?:发布机关|发文机关|发布机构|来源)[：:]{WS}*([^\n]{{2,40}})"
ISSUER_LINE = rf"(?m)^{WS}*([\x{{4e00}}-\x{{9fa5}}]{{4,30}}(?:部|委|局|署|办公厅|人民政府|总局|银行|协会|委员会)){WS}*$"
#: Marks of blocked pages, of empty shells and of archive toolbars.
BLOCKED = [
    r"(?i)just a moment",
    r"(?i)cf-browser-verification|cf_chl_|challenge-platform",
    r"(?i)enable javascript and cookies to continue",
    rf"(?i)请开启{WS}*JavaScript",
    r"(?i)访问验证|安全验证|人机验证|滑动验证|请输入验证码",
    r"(?i)您的访问过于频繁|请求过于频繁|访问受限",
    rf"(?i)403{WS}*Forbidden|Access Denied|拒绝访问",
    r"(?i)请先登录|登录后查看|扫码登录",
    rf"(?i)页面不存在|404{WS}*Not Found",
]
SHELLS = [
    rf"""(?i)<div[^>]+id=["'](?:app|root|__next|__nuxt)["'][^>]*>{WS}*</div>""",
    r"(?i)window\.__(?:NUXT|NEXT|INITIAL_STATE)__",
    r"(?i)data-reactroot|ng-version=|v-cloak",
    r"(?i)<script[^>]+src=[^>]*(?:main|chunk|app)\.[0-9a-f]{6,}\.js",
]
TOOLBARS = [r"(?i)Wayback Machine", rf"(?i)[0-9]+{WS}+captures?\b", r"(?i)About this capture|TIMESTAMPS", r"(?i)Save Page Now|web\.archive\.org/web/[0-9]+/"]
#: What stands for a number or issuer that isn't known.
UNKNOWN = ["", "无", "无文号", "未标明", "无/未标明", "未确认", "未知", "不适用", "未提供", "待确认", "none", "null", "unknown", "n/a", "na", "-", "--"]


#: What PDF texts write in full width, and what numbers are searched in.
HALVED, HALVES = "０１２３４５６７８９（）〔〕［］", "0123456789()[][]"


def halved(text: Column) -> Column:
    return F.translate(text, HALVED, HALVES)


def docno(text: Column, declared: Column | None = None) -> Column:
    """The declared number (80 characters), else the first form found in the first 6000 characters, else empty."""
    head = F.left(text, F.lit(6000))
    # What each Chinese form can't do without is looked for first: it is found or ruled out in one quick scan.
    gates = [rf"[〔\[（(【]{WS}*20[0-9]{{2}}{WS}*[〕\]）)】]{WS}*[0-9]", "令", "公告|通知", *[None] * (len(DOCNOS) - 3)]
    found = [F.nullif(F.regexp_extract(head, p, 0), F.lit("")) if g is None else F.when(head.rlike(g), F.nullif(F.regexp_extract(head, p, 0), F.lit(""))) for p, g in zip(DOCNOS, gates, strict=True)]
    clean = F.trim(F.regexp_replace(F.coalesce(*found), rf"{WS}+", " "))
    given = F.left(F.nullif(F.trim(declared), F.lit("")), F.lit(80)) if declared is not None else F.lit(None).cast("string")
    return F.coalesce(given, clean, F.lit(""))


def issuer(text: Column) -> Column:
    """A labelled issuer, else a line that is only an agency's name, from the first 3000 characters."""
    head = F.left(text, F.lit(3000))
    found = F.coalesce(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in (ISSUER_LABEL, ISSUER_LINE)])
    return F.coalesce(F.left(F.regexp_replace(found, rf"{WS}+", ""), F.lit(60)), F.lit(""))


def blocked_by(html: Column, text: Column) -> Column:
    """What marks the page as blocked, in the order of the marks; NULL if nothing does."""
    hay = F.concat(F.left(html, F.lit(4000)), F.lit("\n"), F.left(text, F.lit(2000)))
    return F.coalesce(*[F.nullif(F.regexp_extract(hay, p, 0), F.lit("")) for p in BLOCKED])


def is_blocked(html: Column, text: Column) -> Column:
    """Whether anything marks the page as blocked: one scan; which mark it is, blocked_by() tells."""
    hay = F.concat(F.left(html, F.lit(4000)), F.lit("\n"), F.left(text, F.lit(2000)))
    return hay.rlike("(?i)" + "|".join(p.removeprefix("(?i)") for p in BLOCKED))


def is_shell(html: Column, text: Column) -> Column:
    return (F.length(text) < 200) & F.left(html, F.lit(20_000)).rlike("(?i)" + "|".join(p.removeprefix("(?i)") for p in SHELLS))


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once however often `use` names it: a one-item array binds it."""
    return F.get(F.transform(F.array(value), use), 0)


def is_navigation(text: Column, least: int = 200) -> Column:
    """A list of links rather than a body: nearly all lines short, or an archive's toolbar."""

    def toolbar(body: Column) -> Column:
        marks = sum((F.when(F.left(body, F.lit(4000)).rlike(p), 1).otherwise(0) for p in TOOLBARS), F.lit(0))
        return (marks >= 2) & (F.length(body) < max(2 * least, 500))

    edges = rf"^{WS}+|{WS}+$"
    lengths = F.filter(F.transform(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, edges, ""))), lambda n: n > 0)
    brief = bound(lengths, lambda x: (F.size(x) >= 12) & (F.size(F.filter(x, lambda n: n <= 12)) >= 0.8 * F.size(x)))
    return brief | bound(F.regexp_replace(text, edges, ""), toolbar)


def status(html: Column, text: Column, least: int = 200, most: int = 0) -> Column:
    """blocked, listing_only, partial or full, the only verdict on how complete a body is."""
    html, text = F.coalesce(html, F.lit("")), F.coalesce(text, F.lit(""))
    out = F.when(is_blocked(html, text) | is_shell(html, text), "blocked").when(F.length(text) < least, "listing_only").when(is_navigation(text, least), "listing_only")
    return (out.when(F.length(text) >= most, "partial") if most else out).otherwise("full")
