"""Template residue, filler, error pages and script notices, found by their likeness to labelled exemplars.

Texts are cut into passages (lines, and sentences within them) and these into terms: words, and pairs of neighbouring
characters of scripts without word breaks. Each term of the exemplars is weighted by its inverse document frequency over the
whole corpus. An inverted index from terms to exemplars retrieves the exemplars that share terms with a passage; the passage is
residue where the exemplars hold at least `share` of its weight, one of them at least `one` of it, and no exemplar of clean text
is as near. A sentence that speaks about an error message holds much else, or is nearer to a clean exemplar. Unfilled
placeholders are read by their syntax alone (MARKS): one is enough, wherever it stands.

Defined results: NULL and empty texts have no residue; texts of any length are searched whole; several rows with
one key give one row, with the highest coverage and all kinds; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from http import HTTPStatus

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.frames import Columns, map_rows
from evidentia.llm.grams import codes
from evidentia.session import spread

#: The kind of exemplars that are no residue.
CLEAN = "clean"
#: Labelled exemplars by kind: what servers, browsers and content systems commonly say, and the like of it that is no residue.
#: A parameter of the operator; extend it with what a corpus shows.
EXEMPLARS: dict[str, list[str]] = {
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
        
        
        "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum",
        "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae, pellentesque habitant morbi tristique senectus et netus", "Your text goes here",
        "Text goes here", "Headline goes here", "Insert your text here", "Body text goes here. Replace it with your own.",
        "This is a sample paragraph, please replace it before publishing", "Placeholder text to be replaced", "Sample text. Replace this sample before publication. Sample content for testing only.",
        "Content coming soon", "To be completed", "To be supplied by the editor", "此处为占位文字，请替换", "此处为示例内容，请在发布前修改", "请在此处输入标题或正文", "请替换为正式内容", "这里是标题文字", "这里填写正文内容",
        "示例文本，仅供测试使用", "测试内容测试内容", "本页内容待补充", "内容正在录入中", "正文待录入", "此段文字待后续补充", "待更新", "Texte provisoire à remplacer avant publication", 
        "Contenu à venir", "Votre texte ici", "Texte à compléter ultérieurement", "Blindtext, bitte vor der Veröffentlichung ersetzen", "Hier steht Ihr Text",
        "Platzhaltertext, wird noch ersetzt", "Inhalt folgt in Kürze", "To be confirmed, replace before publication", "Filler copy, to be supplied by the author",
    ],
    "error": [
        *[f"{x.value} {x.phrase}" for x in HTTPStatus if x >= 400],
        "HTTP Error 404. The requested resource is not found.", "The requested URL was not found on this server.",
        "The page you are looking for could not be found.", "The page you requested does not exist or has been moved or deleted.",
        "Page not found. The address could not be matched to any page or document.", 
        "The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.", "Error establishing a database connection",
        "There has been a critical error on this website.", "Something went wrong on our side. Please try again later.",
        "Oops! Something went wrong. An unexpected error occurred, error code", 
        "Server error in application. Runtime error.", "Fatal error: Uncaught Error: Call to a member function on null in line stack trace", "Traceback (most recent call last)",
        "java.lang.NullPointerException at", "Warning: Undefined variable in on line", "Exception: connection timed out in module, step, trace",
        "The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.",
        "This site is down for maintenance until", "We will be back soon, the site is undergoing scheduled maintenance.",
        "The gateway did not receive a timely response from the upstream server", 
        "The connection has timed out. The server took too long to respond.", "The gateway had no answer in time from upstream",
        "Access denied. You do not have permission to access this page or view this folder on this server.", "You are not authorized to view this page.",
        "Your session has expired. Please log in again. Please sign in again to continue.", "Please log in to view this content.",
        "Too many requests from your network address. Please slow down and retry after seconds.", "Checking your browser before accessing",
        "Checking if the site connection is secure. Verify you are human by completing the action below. Checking that you are not a robot.",
        "Please complete the security check to continue. Ray ID", "Loading, please wait", "The attachment could not be loaded: file or resource missing",
        "The document failed to load. File not found.", "您要查看的页面或内容不存在或已被删除", "抱歉，您要访问的页面找不到了", "您访问的网页地址有误，或已被移除、更名",
        "您访问的地址不存在，可能已被删除或更名，秒后自动返回首页", "秒后自动跳转到首页", "无法找到该页", "系统繁忙，请稍后再试", "系统异常，错误代码", "服务器内部错误", "服务器开小差了，请稍后重试", "网络异常，请刷新重试", "数据库连接超时，请联系管理员",
        "请求超时，请重试", "网关超时，后端服务无响应", "后端服务器无响应，跟踪号", "服务暂不可用", "节点异常", "您没有权限访问该页面", "您无权访问该资源", "网页无法访问，请检查地址是否有误", "对不起，当前账号没有权限查看此栏目", "访问过于频繁，请稍后再试", "请完成安全验证后继续访问", "请拖动滑块完成验证", "请输入验证码",
        "正在进行安全检查，请勿关闭窗口", "登录已过期，请重新登录", "登录状态失效，需要重新登录后才能查看", "网站正在升级维护中，预计时恢复，请稍后访问", "系统维护升级中，暂停服务", "加载中，请稍候", "内容加载中，请稍候", "数据加载失败，请重试", "附件加载失败：文件未找到",
        "资源未找到，代码", "La page que vous cherchez est introuvable", "La page demandée n’existe pas ou a été déplacée. L’adresse ne correspond à aucun document.", "Erreur interne du serveur, code",
        "Service momentanément indisponible, veuillez réessayer plus tard", "Votre session a expiré, veuillez vous reconnecter",
        "Accès refusé. Vous n’avez pas l’autorisation de consulter cette page.", "Site en maintenance jusqu’à", "Chargement en cours, veuillez patienter",
        "Échec du chargement de l’annexe : ressource absente", "Trop de requêtes depuis votre réseau", "Seite nicht gefunden",
        "Die angeforderte Seite wurde nicht gefunden. Der Pfad passt zu keinem Dokument.", "Interner Serverfehler, Kennung", 
        "Dienst vorübergehend nicht verfügbar, bitte versuchen Sie es später erneut", "Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an",
        "Zugriff verweigert. Sie haben keine Berechtigung.", "Wartungsarbeiten bis", "Wird geladen, bitte warten", "Die Anlage konnte nicht geladen werden: Datei fehlt",
        "Zu viele Anfragen aus Ihrem Netz",
    ],
    "script": [
        "Please enable JavaScript to view this page", "You need to enable JavaScript to run this app.", "JavaScript is required to view this site",
        "This site requires JavaScript. Your browser does not support scripts or has scripting switched off.",
        "JavaScript is disabled in your browser. Please turn on scripting and reload the page.", "Enable JavaScript and cookies to continue",
        "Enable scripts to see the content below.", "This website needs JavaScript to work properly.", "本网站需要启用 JavaScript 后才能继续浏览", "请在浏览器设置中启用脚本后刷新页面", "请打开浏览器的脚本支持功能后重新加载本页", "检测到您的浏览器已禁用脚本，请开启浏览器脚本功能", "您的浏览器不支持脚本或脚本已被禁用，页面无法正常显示",
        "您的浏览器已禁用JavaScript，请启用后刷新", "本页面需要启用浏览器脚本才能查看附件内容", "事件 ID，参考编号", "Veuillez activer JavaScript pour afficher cette page",
        "Activez les scripts dans votre navigateur pour lire le contenu", "Merci d’autoriser l’exécution des scripts par votre navigateur",
        "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen", "Diese Seite benötigt JavaScript", "Schalten Sie Skripte in Ihrem Browser ein, um den Inhalt anzuzeigen",
    ],
    "clean": [
        "In this section", "You are here: Home, News", "Vous êtes ici : Accueil", "Sie sind hier: Start", "当前位置：首页", "Did you find this page helpful?", "You may also like", "The online form works only in a browser that has scripts enabled.", "À lire aussi", "Auch interessant", "Les plus consultés", "Ce texte n’a pas de valeur contractuelle", "Report an error on this page", "Share this page", "Print this page", "Related pages", "Back to top", "Skip to main content",
        "This guidance does not constitute legal advice", "This page was last updated", "See the section below", "Sign up for updates", 
        "Cookie settings", "Where a portal shows the message page not found, the operator must repair the link within days.",
        "Firms must report an internal server error to the office within hours.", "Forms must not contain sample text or placeholders when they are filed.",
        "A site that requires scripts must offer an accessible version.", "An error in the return must be corrected.",
        "If two returns are late the office may appoint a reviewer.", "If the service is unavailable for more than hours, the firm must notify users.",
        "The system will be down for maintenance on the date notified by the operator.", "Une erreur sur cette page ? Signalez-la", 
        "Cette page vous a-t-elle été utile ?", "Toute erreur relevée est corrigée sous jours.", "Si le portail affiche page introuvable, l’opérateur corrige le lien.",
        "Haben Sie einen Fehler auf dieser Seite gefunden?", "Seite drucken", "War diese Seite hilfreich?",
        "Zeigt das Portal Seite nicht gefunden an, behebt der Betreiber den Fehler.", "发现本页内容有误，请反馈给我们", "本页内容是否有帮助", "打印本页", 
        "门户提示页面不存在的，运营单位应当及时修复。", "系统中断超过小时的，应当报告。", "系统出现服务器内部错误的，应当在日内书面说明。", "登录系统后填写申请表。", "不得以示例文字代替正文。", "网站要求启用脚本的，应当提供替代方式。", "本网站使用 Cookie，继续浏览即表示同意", 
        "请登录系统提交材料", 
    ],
}

#: Field names that stand in brackets where nobody has filled them in.
_FIELD = r"(?:名称|机关|单位|事项|标题|正文|内容|日期|姓名|文号|部门|地址)"
_FIELDS = r"(?:YOUR|INSERT|ENTER|NAME|TITLE|DATE|BODY|ORGANI[SZ]ATION|COMPANY|ADDRESS|NOM|TITRE|VOTRE|NAMEN?|STELLE|BEHÖRDE|DATUM|TITEL|IHR)"
_DATE = r"[XxＸ×_＿]{2,}\s?年\s?[XxＸ×_＿]+\s?月"
#: The syntax of placeholders and of values that a script left unset, each after what it can't do without.
MARKS: list[tuple[str, re.Pattern[str]]] = [
    (gate, re.compile(pattern, re.M))
    for gate, pattern in [
        ("{{", r"\{\{[^{}\n]+\}\}"), ("{%", r"\{%[^%\n]+%\}"), ("${", r"\$\{[^{}\n]+\}"), ("#{", r"#\{[^{}\n]+\}"), ("<%", r"<%[^%\n]+%>"), ("%%", r"%%[A-Za-z]\w*%%"), ("%", r"%[A-Z][A-Z0-9_]{2,}%"),
        ("@@", r"@@[A-Za-z]\w*@@"), ("[[", r"\[\[[A-Z][A-Z0-9_]*\]\]"), ("__", r"__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__"), ("<<", r"<<[A-Z][A-Z0-9_ ]*>>"), ("«", r"«[A-Za-z]+_[A-Za-z_]+»"), ("{", r"(?<![$#{])\{[A-Z][A-Z0-9_]{2,}\}(?!\})"),
        ("[object", r"\[object Object\]"), ("undefined", r"\bundefined\s+(?:undefined|null|NaN)\b"), ("null", r"\bnull\s+(?:undefined|null|NaN)\b"), ("NaN", r"\bNaN\s+(?:undefined|null|NaN)\b"), ("Invalid Date", r"\bInvalid Date\b"),
        ("<insert", r"<insert [^<>\n]+>"), ("<enter", r"<enter [^<>\n]+>"), ("[", rf"\[{_FIELDS}\b[^\[\]\n]{{0,60}}\](?!\()|\[(?:Your|Insert|Enter|Votre|Ihr) [^\[\]\n]{{1,40}}\](?!\()|\[[^\[\]\n]{{0,8}}{_FIELD}\](?!\()"),
        ("【", rf"关于【[^】\n]{{1,12}}】的|^[ \t　：:]*(?:【[^】\n]{{0,8}}{_FIELD}[^】\n]{{0,4}}】[ \t　：:]*)+$"),
        *((x, _DATE) for x in ("XX", "xx", "ＸＸ", "××", "__", "＿＿")), ("YYYY", r"\bDD (?:Mon|Month) YYYY\b"), ("AAAA", r"\bJJ mois AAAA\b"), ("JJJJ", r"\bTT\.? Monat JJJJ\b"),
    ]
]
_LATIN_ENDINGS = re.compile(r"(?:[aeiou]m|[aeiou]s|[aeiou]t|nt|or|ur|[aeio])$")
#: Closed-class words of the languages written in Latin letters: a sentence of theirs has some.
_SMALL_WORDS = frozenset("the a an of to in on at by for from with and or not is are was were be been has have had will shall may must this that these those it its as if than then which who le la les un une des du de et ou en au aux est sont dans par pour sur avec sans ce cette ces qui que dont il elle se sa son ses leur pas ne der die das den dem des ein eine einer eines und oder nicht ist sind war wird werden im am zu zum zur von vom mit für auf aus bei nach über unter vor sich".split())
_VARIABLE = re.compile(r"(?:https?://|/)[\w./?=&%-]*|(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{6,}(?![A-Za-z0-9])")
_PASSAGE = re.compile(r"(?:[^。！？!?；;\n.…]|\.(?=\S))+")
_TERM = re.compile(r"[A-Za-zÀ-ɏ]+|[一-鿿]+")
#: The longest unit whose repetition is looked for, and the characters that lost bytes repeat.
_UNIT, _LOST = 12, frozenset("锟斤拷烫屯葺")
#: What ends a passage around a repetition.
_ENDS = "\n。！？!?；;…"


def bare(text: str) -> str:
    """A text without paths and identifiers, which differ from page to page."""
    return _VARIABLE.sub(" ", text)


def passages(text: str) -> list[str]:
    return [x for x in _PASSAGE.findall(text) if not x.isspace()]


def terms(passage: str) -> set[str]:
    """Words in lower case and pairs of Han characters; numbers are left out."""
    out: set[str] = set()
    for x in _TERM.findall(passage):
        if x[0] < "一":
            out.add(x.lower())
        elif len(x) > 1:
            out.update(map(str.__add__, x, x[1:]))
        else:
            out.add(x)
    return out


def repeats(text: str, share: float = 0.5) -> bool:
    """Whether a unit of 2 to _UNIT letters stands three times or more in a row and so fills at least `share` of its passage."""
    c = codes(text)
    for p in range(2, _UNIT + 1):
        breaks = np.flatnonzero(c[p:] != c[:-p])
        ends = np.concatenate([[-1], breaks, [max(0, len(c) - p)]])
        for i in np.flatnonzero(np.diff(ends) > 2 * p):
            start, stop = int(ends[i]) + 1, int(ends[i + 1]) + p
            unit = text[start : start + p]
            if unit.isalpha() and len(set(unit)) > 1 and _LOST.isdisjoint(unit):
                left = max(text.rfind(x, 0, start) for x in _ENDS) + 1
                right = min((at for x in _ENDS if (at := text.find(x, stop)) >= 0), default=len(text))
                if stop - start >= share * len(text[left:right].strip()):
                    return True
    return False


def marks(text: str) -> set[str]:
    """The kinds of the placeholders in a text."""
    found = {"template"} if any(gate in text and mark.search(text) for gate, mark in MARKS) else set()
    return found | ({"filler"} if repeats(text) else set())


def pseudo_latin(passage: str) -> bool:
    """Whether a passage is dummy Latin: five words or more, nearly all with Latin endings, none that other languages can't do without."""
    if not passage.isascii() or len(words := passage.split()) < 5:
        return False
    plain = [w.strip(",;:()").lower() for w in words]
    return _SMALL_WORDS.isdisjoint(plain) and all(w.isalpha() for w in plain) and sum(bool(_LATIN_ENDINGS.search(w)) for w in plain) >= 0.8 * len(plain) and sum(w[0].isupper() for w in words) * 3 <= len(words)


class ResidueIndex:
    """The inverted index: the exemplars that hold each term, and the weight of each term."""

    def __init__(self, exemplars: dict[str, list[str]] = EXEMPLARS):
        each = [(kind, terms(bare(x))) for kind, own in exemplars.items() for x in own]
        self.kinds = [kind for kind, _ in each]
        self.terms = [own for _, own in each]
        self.postings: dict[str, list[int]] = defaultdict(list)
        for i, own in enumerate(self.terms):
            for term in own:
                self.postings[term].append(i)
        self.known = frozenset(self.postings)
        self.weigh({}, 0)

    def weigh(self, df: dict[str, int], n_docs: int) -> None:
        """Sets the weights from document frequencies; terms that the index lacks get the median weight."""
        from math import log, sqrt

        self.weight = {t: log((n_docs + 2) / (df.get(t, 0) + 1)) + 0.1 for t in self.postings}
        self.other = sorted(self.weight.values())[len(self.weight) // 2] if self.weight else 1.0
        self.most = max(self.weight.values(), default=1.0)
        self.norms = [sqrt(sum(self.weight[t] ** 2 for t in own)) for own in self.terms]

    def judge(self, own: set[str], share: float, one: float, least: float) -> tuple[str, float] | None:
        """The kind of a passage with these terms and its coverage, if it is residue."""
        hits = own & self.known
        # Even at the highest weight, fewer hits can't make up the share.
        if len(hits) < 2 or len(hits) * self.most * (1 - share) < share * (len(own) - len(hits)) * self.other:
            return None
        weights = self.weight
        total = sum(weights.get(t, self.other) for t in own)
        held, near, dot, good = 0.0, defaultdict(float), defaultdict(float), False
        for t in hits:
            w, residue = weights[t], False
            for e in self.postings[t]:
                near[e] += w
                dot[e] += w * w
                residue = residue or self.kinds[e] != CLEAN
            if residue:
                held += w
        if held < share * total or held < least and len(hits) < 4:
            return None
        cosine = {e: x / self.norms[e] for e, x in dot.items()}
        best = max((e for e in near if self.kinds[e] != CLEAN), key=lambda e: (cosine[e], -e), default=None)
        good = best is not None and max(x for e, x in near.items() if self.kinds[e] != CLEAN) >= one * total
        clean = max((x for e, x in cosine.items() if self.kinds[e] == CLEAN), default=0.0)
        return (self.kinds[best], held / total) if good and cosine[best] > clean else None


def document_frequencies(texts: DataFrame, index: ResidueIndex) -> tuple[dict[str, int], int]:
    """How many texts hold each term of the index, and how many there are. The result has the size of the index."""
    known = index.known

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        total: Counter[str] = Counter()
        n = 0
        for b in batches:
            for text in b["t"]:
                total.update(known & terms(bare(text)))
                n += 1
        if n:
            yield "", n
            yield from total.items()

    df = dict(map_rows(texts, run, "term string, n long").groupBy("term").agg(F.sum("n")).collect())
    return df, df.pop("", 0)


def found_in(text: str, index: ResidueIndex, share: float, one: float, least: float) -> dict[str, float]:
    """The kinds of residue in a text, each with its highest coverage."""
    found = dict.fromkeys(marks(text), 1.0)
    for passage in passages(bare(text)):
        hit = index.judge(terms(passage), share, one, least) or (("filler", 1.0) if pseudo_latin(passage) else None)
        if hit:
            found[hit[0]] = max(hit[1], found.get(hit[0], 0.0))
    return found


def residue(df: DataFrame, key: str = "article_id", text: str = "text", share: float = 0.55, one: float = 0.25, least: float = 6.0, exemplars: dict[str, list[str]] = EXEMPLARS) -> DataFrame:
    """key, coverage, kinds of the texts that hold residue. `least` is the weight of a passage with fewer than four known terms."""
    docs = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t <> ''"))
    index = ResidueIndex(exemplars)
    index.weigh(*document_frequencies(docs.select("t"), index))

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, t in zip(b["k"], b["t"], strict=True):
                for kind, best in found_in(t, index, share, one, least).items():
                    yield k, kind, best

    kind = dict(docs.dtypes)["k"]
    found = map_rows(docs, run, f"k {kind}, kind string, best double")
    return found.groupBy(F.col("k").alias(key)).agg(F.max("best").alias("coverage"), F.array_sort(F.collect_set("kind")).alias("kinds"))


def without_residue(df: DataFrame, key: str = "article_id", text: str = "text", **how) -> DataFrame:
    """The rows of df whose text holds no residue."""
    return df.join(residue(df, key, text, **how).select(key), key, "left_anti")
