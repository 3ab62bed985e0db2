"""The main body of web pages, told from page furniture by a linear-chain conditional random field.

A page is a chain of leaf blocks: the text blocks of its DOM with their ancestor tags, or the lines of a text whose
tags are gone. Each block is main body, site notice (reprint and share lines, bylines, which also occur outside whole pages)
or page furniture (menus, breadcrumbs, cookie notices, sidebars, footers). Weights of block features and transitions are
trained by gradient ascent on the log-likelihood of labelled pages; Viterbi decodes the best chain. A text holds a whole
page if at least `least` of its blocks are furniture and none of the lines that its source repeats; then all blocks that are not
main body are reported.

The labelled pages (TRAIN_PAGES of them, the bound of the training sample) are laid out from the labelled blocks below, as lines
and as the blocks of several page layouts with their tags.

Defined results: NULL and empty texts hold no page; blank lines in a page are not main body; texts of any length are decoded
whole; rows that share a key give each line once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.frames import Columns, map_rows
from evidentia.llm.repeated_lines import line_key
from evidentia.session import cut, small, spread

MAIN, NOTICE, FURNITURE = range(3)
#: How many labelled pages the model is trained on, in how many steps.
TRAIN_PAGES, STEPS, BITS = 1000, 100, 14

#: Labelled blocks by language, as sites of authorities commonly have them: menu words, furniture lines, list headings, site notices.
_WORDS = {
    "zh": "首页 新闻 要闻 公告 通知 政策 法规 解读 服务 互动 数据 专题 图片 视频 机构 概况 领导 信息公开 在线服务 办事指南 咨询投诉 意见征集 下载专区 招聘 网站导航 搜索 登录 注册 退出 繁体 英文版 手机版 无障碍 返回首页 回到顶部 收藏本站 设为首页 上一页 下一页 更多 展开 关闭".split(),
    "en": "Home|News|Publications|Services|About us|Contact us|Jobs|Events|Search|Sign in|Log in|Register|Menu|Help|FAQ|Topics|Statistics|Legislation|Guidance|Forms|Press|Archive|Accessibility|Site map|Site index|Back to top|Skip to content|Skip to navigation|Show all|See more|Print|Share|Subscribe|Close|Next|Previous|English".split("|"),
    "fr": "Accueil|Actualités|Publications|Services|Qui sommes-nous|Nous contacter|Emploi|Agenda|Rechercher|Se connecter|S’inscrire|Menu|Aide|Thèmes|Statistiques|Textes officiels|Formulaires|Presse|Archives|Accessibilité|Plan du site|Retour en haut|Aller au contenu|Voir plus|Imprimer|Partager|Fermer|Suivant|Précédent".split("|"),
    "de": "Startseite|Aktuelles|Veröffentlichungen|Service|Über uns|Kontakt|Karriere|Termine|Suche|Anmelden|Registrieren|Menü|Hilfe|Themen|Statistik|Gesetze|Formulare|Presse|Archiv|Barrierefreiheit|Inhaltsverzeichnis|Seitenanfang|Zum Inhalt|Mehr anzeigen|Drucken|Teilen|Schließen|Weiter|Zurück|Leichte Sprache".split("|"),
}
_LINES = {
    "zh": ["ICP备案号：{n}", "网警备案 {n} 号", "网站编号：{n}", "版权归{org}所有 2001-2025", "Copyright © {org} 版权所有", "技术支持：某某科技公司　访问量：{n}", "管理单位：{org}　维护：信息中心", "今日天气：晴，{m}～{k}℃", "{m}月{k}日　星期五　小雨", "联系方式 | 法律声明 | 隐私政策 | 版权说明", "隐私条款｜使用条款｜联系站长", "推荐使用主流浏览器浏览本站，分辨率不低于 1024×768", "上一条：{title}", "下一条：{title}", "前一篇 {title}", "后一篇 {title}", "附件：{title}.doc", "文件下载：{title}.pdf（{n}KB）", "下载次数 {n}", "请选择语言：中文 / English", "站内搜索：请输入关键词", "热词：预算 统计 招标", "本站使用 Cookie 改善浏览体验。接受全部 / 仅限必要", "Cookie 偏好：功能类、统计类、广告类　保存选择", "我们使用 Cookie 记录访问情况［同意］［不同意］", "当前在线 {n} 人　累计访问 {m} 万次", "字号：小 中 大", "关注我们：微信 微博 客户端", "服务热线 {n}", "地图 | 帮助 | 订阅"],
    "en": ["Privacy policy | Terms of use | Disclaimer | Contact", "Legal notice · Data protection · Sitemap", "© 2001-2025 {org}", "Copyright {org}. Site visitors: {n}", "Connect with us: Twitter, Facebook, RSS", "Follow: newsletter, feed, podcast", "Registered number {n}. Head office address on our contact page", "Last generated 11:42, record {n}", "Page reference {n}", "This website uses cookies to give you the best experience. Accept | Decline | Settings", "We place cookies on your computer. Allow all | Essential only", "Manage cookie preferences: functional, analytics, marketing", "Choose font size: small medium large", "Choose your language: English / Français / Deutsch", "Previous article: {title}", "Next article: {title}", "Previous {title}", "Next {title}", "Attachment: {title}.pdf", "Download this file ({n} KB)", "PDF, {n} KB", "{org} is an independent authority.", "Supported by {org}", "Enter keywords to search this site", "{n} people are viewing this site"],
    "fr": ["Mentions légales | Confidentialité | Contact", "Données personnelles · Accessibilité · Aide", "© 2001-2025 {org}", "Suivez-nous : Twitter, Facebook, RSS", "Nous utilisons des cookies pour améliorer votre visite. Accepter tout | Refuser | Paramétrer", "Choix des cookies : fonctionnels, statistiques, publicité", "Taille des caractères : petite moyenne grande", "Page précédente : {title}", "Page suivante : {title}", "Pièce jointe : {title}.pdf", "Télécharger le fichier ({n} Ko)", "{org}, numéro d’identification {n}", "Nombre de visites : {n}", "Saisissez un mot-clé"],
    "de": ["Impressum | Datenschutz | AGB | Kontakt", "Datenschutzerklärung · Barrierefreiheit · Hilfe", "© 2001-2025 {org}", "Folgen Sie uns auf Twitter, Facebook, RSS", "Wir verwenden Cookies, um die Seite zu verbessern. Alle zulassen | Nur notwendige | Auswahl", "Cookie-Auswahl: notwendig, Statistik, Werbung", "Schrift: klein mittel groß", "Vorheriger Artikel: {title}", "Nächster Artikel: {title}", "Anhang: {title}.pdf", "Datei laden ({n} KB)", "{org}, Registernummer {n}", "Bisherige Besuche: {n}", "Suchbegriff eingeben"],
}
#: Furniture of over 160 characters is laid out from several of these.
_LONG = {
    "zh": ["本网站使用 Cookie 保存您的浏览设置并统计访问量，继续浏览即表示您同意我们的隐私声明。", "您可以随时在浏览器中更改 Cookie 设置，拒绝统计类和营销类 Cookie 不影响必要功能的使用。", "版权所有 {org}，未经许可不得转载，网站地图、联系我们和免责声明见页面底部。", "管理单位：{org}　网站编号 {n}　备案 {n} 号。", "建议使用分辨率较高的浏览器访问本网站，您是第 {n} 位访客。"],
    "en": ["We use cookies to remember your settings, to measure visits and to improve this website.", "You can accept or reject cookies at any time in your browser or in our privacy settings.", "By continuing to browse this site you agree to our cookie policy, privacy notice and terms of use.", "Copyright 2001-2025 {org}. All rights reserved. Legal notice, imprint, accessibility and site map are linked below."],
    "fr": ["Ce site utilise des cookies pour mesurer l’audience et retenir vos préférences de navigation.", "Vous pouvez accepter ou refuser les cookies à tout moment dans les réglages de confidentialité.", "{org}, tous droits réservés, mentions légales, plan du site et accessibilité en bas de page."],
    "de": ["Diese Website verwendet Cookies, um Ihre Einstellungen zu speichern und Besuche zu zählen.", "Sie können Cookies jederzeit in den Einstellungen zum Datenschutz annehmen oder ablehnen.", "Alle Rechte vorbehalten, {org}, Impressum, Datenschutz und Übersicht finden Sie unten."],
}
_HEADS = {
    "zh": "相关新闻 推荐阅读 热门文章 最新信息 最新动态 相关文档 相关链接 本周热点 点击排行 您可能感兴趣 栏目导航 同类文章".split(),
    "en": "Related articles|Related documents|Most popular|Latest news|Recommended for you|See also|Trending|Recent publications|More on this topic|Quick links".split("|"),
    "fr": "Articles récents|Sur le même sujet|Les plus lus|Voir aussi|Dernières publications|Liens utiles|À la une".split("|"),
    "de": "Ähnliche Artikel|Zum selben Thema|Am häufigsten gelesen|Siehe auch|Neueste Meldungen|Nützliche Links|Das könnte Sie interessieren".split("|"),
}
_CRUMBS = {
    "zh": ["当前位置：首页 > {a} > {b}", "您所在的位置：{a} / {b} / 正文", "首页 » {a} » {b}", "首页 > {a} > 详情", "位置：{a}＞{b}"],
    "en": ["Home > {a} > {b}", "You are here: {a} / {b}", "Home » {a} » {b}", "{a} › {b} › Current page", "Start / {a} / {b}"],
    "fr": ["Accueil > {a} > {b}", "Vous êtes ici : {a} / {b}", "{a} › {b} › Page actuelle", "Accueil » {a} » {b}"],
    "de": ["Startseite > {a} > {b}", "Sie befinden sich hier: {a} / {b}", "{a} › {b} › Aktuelle Seite", "Start » {a} » {b}"],
}
_NOTICES = {
    "zh": ["来源：{org}　浏览次数：{n}", "信息来源：{org}", "作者：本站　点击数：{n}", "责任编辑：{k}号", "编辑：文字组　审核：{org}", "（校对：{n}）", "分享至：微信 微博 邮件", "分享本页　收藏　打印", "扫描二维码关注{org}", "扫码在手机上阅读", "欢迎关注{org}公众号", "打印　字体：小 中 大", "发现错误？请向我们反馈", "以上信息仅供参考，请以原文为准。", "解释以发布机关的文本为准。", "转载请注明出处：{org}", "本文归{org}所有，请勿擅自转载。"],
    "en": ["Viewed {n} times", "Views: {n}", "Page {n} of the printed issue", "Photo: archive", "Desk editor no. {n}", "Edited by the online team, ref {n}", "Did you find this helpful? Yes | No", "Tell us if something is wrong with this page", "This summary is for information only.", "The official text prevails.", "It does not constitute advice.", "Share this article: email | print | link", "Get updates from {org} by email", "© {org}. Reproduction requires permission."],
    "fr": ["Vu {n} fois", "Consulté {n} fois", "Rédaction web no {n}", "Recevez nos lettres d’information", "Une erreur ? Écrivez-nous", "Document à titre d’information uniquement.", "Seul le texte officiel fait foi.", "© {org}. Toute reproduction est soumise à accord.", "Partager : courriel | imprimer | lien"],
    "de": ["{n} mal gelesen", "Zugriffe: {n}", "Onlineredaktion Nr. {n}", "Newsletter bestellen", "Fehler gefunden? Schreiben Sie uns", "Nur zur Information.", "Maßgeblich ist der amtliche Text.", "© {org}. Vervielfältigung nur mit Genehmigung.", "Beitrag teilen: Mail | Drucken | Link"],
}
_ORGS = {"zh": "某某市人民政府网 省级政策信息网 开发区管委会网站 监管要闻 海关公告栏 市场动态 县政府公报".split(), "en": ["City Council bulletin", "National Audit Office", "Port Authority news", "Financial Services Agency", "Ministry gazette"], "fr": ["Préfecture de région, actualités", "Autorité de régulation", "Ministère, bulletin officiel"], "de": ["Landesamt, Mitteilungen", "Bundesanstalt, Aktuelles", "Ministerium, Amtsblatt"]}
_TITLES = {
    "zh": ["关于印发{x}工作规则的通知", "关于{x}有关问题的公告", "关于加强{x}管理的意见", "关于做好{x}工作的函", "{x}暂行办法", "{x}管理规定（试行）", "《{x}条例》解读", "关于{x}情况的通报", "关于公开征求{x}办法意见的通告", "关于{x}的说明", "关于发布{x}标准的决定"],
    "en": ["Regulations on {x}", "Guidelines for {x}", "Notice on {x}", "Public consultation: {x}", "Report on {x}, {n}", "Changes to {x}", "Decision concerning {x}", "Policy statement: {x}", "How to comply with rules on {x}", "Order on {x}: what changes for firms"],
    "fr": ["Avis relatif à {x}", "Décision concernant {x}", "Consultation publique : {x}", "Circulaire sur {x}", "Arrêté relatif à {x}", "Rapport sur {x}"],
    "de": ["Verordnung über {x}", "Bekanntmachung zu {x}", "Öffentliche Anhörung: {x}", "Rundschreiben: {x}", "Beschluss über {x}", "Leitfaden für {x}"],
}
_TOPICS = {"zh": "危险货物运输 个人所得税申报 安全生产检查 城市供水 企业年度报告 食品经营许可 保险资金运用 出口退税 知识产权保护 环境影响评价 政府采购 会计信息质量".split(), "en": ["road transport of goods", "income tax returns", "food safety checks", "the supply of water", "annual accounts", "public procurement", "insurance brokers and their clients", "export licences", "patents", "data protection in banks"], "fr": ["le transport de marchandises", "la déclaration de revenus", "la sécurité alimentaire", "la distribution d’eau", "les marchés publics", "la protection des données"], "de": ["die Beförderung von Gütern", "die Steuererklärung", "die Lebensmittelsicherheit", "die Wasserversorgung", "die Vergabe von Aufträgen", "den Datenschutz"]}
_DOCNOS = {"zh": ["国发〔2020〕{n}号", "税总函〔2019〕{k}号", "工信部规〔2022〕{n}号", "市府办〔2018〕{k}号"], "en": ["Reference: ABC/XY/2022/{n}", "Ref: FSA-21/{n}", "Reference: PA-DR/2020/{k}"], "fr": ["Référence : MIN-DG/2021/{n}", "Réf. : AR/2020/{k}"], "de": ["Aktenzeichen: BA-III/2021/{n}", "Az.: LA 4/{k}"]}
_GREET = {"zh": ["各省、自治区、直辖市人民政府：", "各区县财政局、税务局：", "各有关企业：", "各直属机构、各会员单位：", "各商业银行、保险公司："], "en": ["To all member firms,", "Dear Sir or Madam,", "To the chief executives of insurers,", "Dear all,"], "fr": ["À l’attention des entreprises agréées,", "Mesdames, Messieurs,"], "de": ["An alle Mitgliedsunternehmen,", "Sehr geehrte Damen und Herren,"]}
_SIGNS = {"zh": ["某某市财政局　2021年{m}月{k}日", "国家税务部门　2019年{m}月{k}日（盖章）", "自治区商务厅　2022年{m}月{k}日", "市场监督管理局　2020年{m}月{k}日"], "en": ["Port Authority, Legal Department, {k} May 2021", "Ministry of Transport, Safety Unit, {k} October 2019", "National Audit Office, Policy Team, {k} January 2022"], "fr": ["Ministère des transports, Service juridique, {k} mai 2021", "Autorité de régulation, Bureau des normes, {k} octobre 2020"], "de": ["Landesamt für Verkehr, Rechtsabteilung, {k}. Mai 2021", "Bundesanstalt, Grundsatzreferat, {k}. Oktober 2020"]}
_CLAUSES = {
    "zh": ["从事{x}的单位应当在{m}月{k}日前报送有关材料，逾期不报的，依法处理。", "{x}的管理坚持公开、公平、公正的原则，任何单位和个人不得干预。", "主管部门应当自收到申请之日起{k}个工作日内作出决定，并书面告知理由。", "违反前款规定的，由主管部门责令改正，可以处{n}元以下罚款。", "用于{x}的资金不得超过年度预算的{k}%，结余资金应当上缴。", "本规定自2021年{m}月1日起施行，由发布机关负责解释。", "企业对{x}的真实性负责，相关档案保存不少于{m}年。"],
    "en": ["An operator that carries out {x} must notify the authority within {m} days.", "The authority decides within {k} working days and gives reasons in writing.", "A fine of up to {n} may be imposed where the duty in the preceding paragraph is breached.", "Spending on {x} may not exceed {k}% of the annual budget.", "Records concerning {x} are kept for at least {m} years.", "These rules enter into force on 1 June 2022 and replace the earlier ones."],
    "fr": ["L’exploitant déclare {x} à l’autorité dans un délai de {m} jours.", "L’autorité statue sous {k} jours ouvrables et motive sa décision.", "Les dépenses relatives à {x} ne dépassent pas {k}% du budget annuel.", "Le présent arrêté entre en vigueur le 1er juin 2022."],
    "de": ["Der Betreiber zeigt {x} der Behörde binnen {m} Tagen an.", "Die Behörde entscheidet binnen {k} Werktagen und begründet ihre Entscheidung.", "Ausgaben für {x} dürfen {k}% des Jahreshaushalts nicht übersteigen.", "Diese Verordnung tritt am 1. Juni 2022 in Kraft; § {m} bleibt unberührt."],
}
#: Ancestor tags (the last two) in which sites put each part; the first layout is a text whose tags are gone.
_LAYOUTS = [
    {},
    {"menu": "nav ul", "crumb": "nav p", "title": "main h1", "body": "main p", "side": "aside ul", "foot": "footer p", "notice": "main p"},
    {"menu": "div ul", "crumb": "div div", "title": "div h1", "body": "div p", "side": "div ul", "foot": "div p", "notice": "div p"},
    {"menu": "header ul", "crumb": "header p", "title": "article h2", "body": "article p", "side": "section ul", "foot": "footer div", "notice": "article p"},
    {"menu": "nav", "crumb": "nav ol", "title": "section h1", "body": "section p", "side": "aside div", "foot": "footer", "notice": "section div"},
    {"menu": "tr td", "crumb": "tr td", "title": "td h3", "body": "td p", "side": "tr td", "foot": "tr td", "notice": "td p"},
]
_MARKS = {"zh": ["第{c}条　", "{c}、", "（{c}）", ""], "en": ["({l}) ", "{k}. ", "Article {k} – ", ""], "fr": ["({l}) ", "{k}. ", "Article {k} – ", ""], "de": ["§ {k} ", "{k}. ", "({l}) ", ""]}

_CLAUSE = re.compile(r"第[一二三四五六七八九十百]+[条章]|[一二三四五六七八九十]{1,3}、|（[一二三四五六七八九十]{1,3}）|\([a-z0-9]{1,3}\)|[0-9]{1,3}[.)] |§ ?[0-9]|Article [0-9]|Art\. [0-9]")
_DOCNO = re.compile(r"〔[0-9]{4}〕|\[[0-9]{4}\]|^(?:Reference|Ref|Référence|Aktenzeichen)\b.{0,3}:")
_DATE_END = re.compile(r"[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日(?:（.{1,4}）)?$|[0-9]{1,2}\.? [A-ZÀ-Ýa-zà-ÿ]{3,9} [0-9]{4}$")
_SEPARATOR = re.compile(r"[|｜·›»>/]")
_GREETING = re.compile(r"^(?:各|致|To |Dear |An |À l).{2,60}[：:,，]$")
_TITLE = re.compile(r"^(?!.{2,6}：)(?:(?:关于|《).{4,60}|.{6,60}(?:通知|公告|办法（试行）|办法|通报|解读|说明|的函|通告|意见|决定)$)|^(?:Rules|Guidance|Notice|Consultation|Findings|Update|Statement|Avis|Décision|Instruction|Mitteilung|Regelung|Hinweise|Anhörung|Merkblatt|Anordnung)\b")
_ODD = re.compile(r"[\x80-\x9f¡-¶¸-ÆÈ-ßð÷ø-ÿĀ-˿Ѐ-ӿ─-▟가-힣\ue000-\uf8ff\ufffd]")
#: What stands where text was decoded wrongly: pairs of Western characters, lost, private, circled and phonetic ones.
_GARBLED = re.compile(r"[ÃÂÐÑГВ├┬√‚][^\sA-Za-z0-9]|â€|[�\ue000-\uf8ff①-⓿ㄅ-ㄯ]")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[一-鿿]+")


def coarse(line: str) -> str:
    """The rough shape of a block."""
    if not line:
        return "blank"
    if len(line) > 1 and _CLAUSE.match(line) and len(line) > 12:
        return "clause"
    if _DOCNO.search(line) and len(line) < 50:
        return "docno"
    if _GREETING.match(line):
        return "greeting"
    if len(line) > 45 and line[-1] in "。.；;！!":
        return "long"
    if _DATE_END.search(line) and len(line) < 110:
        return "dated"
    if _SEPARATOR.search(line):
        return "separated"
    if _TITLE.match(line):
        return "title"
    if len(line) <= (8 if _HAN.search(line) else 16):
        return "word"
    if line[-1] in "。.":
        return "sentence"
    return "other"


@functools.lru_cache(200_000)
def _id(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _own(line: str, tags: str) -> tuple[str, tuple[int, ...]]:
    """Shape and feature numbers that depend on the block alone; short blocks repeat and are kept."""
    return _short(line, tags) if len(line) < 60 else _features(line, tags)


@functools.lru_cache(20_000)
def _short(line: str, tags: str) -> tuple[str, tuple[int, ...]]:
    return _features(line, tags)


def _features(line: str, tags: str) -> tuple[str, tuple[int, ...]]:
    shape = coarse(line)
    out = [f"c={shape}", f"t={tags}", f"l={min(9, len(line) // 12)}", f"e={line[-1:] if line[-1:] in '。.：:；;）)℃次' else ''}", f"s={min(4, len(_SEPARATOR.findall(line)))}", f"d={min(4, len(_DIGIT.findall(line)) // 3)}", f"g={min(4, len(_ODD.findall(line)) * 8 // len(line))}"]
    # Words and bigrams of the whole block, each once.
    seen = {f"w={w}" for w in _WORD.findall(line.lower()) if not _HAN.match(w)}
    for run in _HAN.findall(line):
        seen.update(f"b={run[i : i + 2]}" for i in range(len(run) - 1))
    out += seen
    out += [f"f={line[:2]}", f"x={line}" if len(line) < 24 else "x"]
    return shape, tuple(map(_id, out))


@functools.lru_cache(20_000)
def _around(before2: str, before: str, shape: str, after: str, after2: str, place: int, started: bool, more: bool) -> tuple[int, ...]:
    return tuple(
        _id(x)
        for x in (
            f"p={before}", f"n={after}", f"pc={before},{shape}", f"nc={shape},{after}", f"pcn={before},{shape},{after}", f"nn={shape},{after},{after2}", f"pp={before2},{before},{shape}",
            f"at={place},{shape}", f"in={started},{more},{shape}", f"inp={started},{more},{before},{shape}", f"ins={started},{shape},{after}",
        )
    )


def features(blocks: list[tuple[str, str]]) -> list[tuple[int, ...]]:
    """Feature numbers of each (ancestor tags, text) block of a page."""
    own = [_own(text, tags) for tags, text in blocks]
    shapes = ["start", "start", *[x[0] for x in own], "end", "end"]
    body = [i for i, (s, _) in enumerate(own) if s in ("clause", "long")]
    first, last = (body[0], body[-1]) if body else (len(own), -1)
    out = []
    for i, (shape, ids) in enumerate(own):
        place = min(i, 2) if i < 3 else 7 - min(len(own) - 1 - i, 4)
        out.append(ids + _around(shapes[i], shapes[i + 1], shape, shapes[i + 3], shapes[i + 4], place, i > first, i < last))
    return out


Page = tuple[list[tuple[str, str]], list[int]]


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 11) -> list[Page]:
    """(ancestor tags, text) of the blocks of pages laid out from the labelled blocks, and their labels; about half hold no furniture."""
    from evidentia.llm.encodings import CHAINS, garble
    from evidentia.llm.residue import CLEAN, EXEMPLARS

    rng = random.Random(seed)
    pages: list[Page] = []
    for i in range(n):
        lang = ("zh", "en", "fr", "de")[rng.choice((0, 0, 1, 1, 2, 3))]
        layout = _LAYOUTS[0] if rng.random() < 0.6 else rng.choice(_LAYOUTS[1:])

        def fill(text: str, lang: str = lang) -> str:
            title = rng.choice(_TITLES[lang]) if "{title}" in text else ""
            text = text.replace("{title}", title)
            a, b = rng.sample(_WORDS[lang], 2)
            return text.format(n=rng.randint(2, 99_999), m=rng.randint(1, 12), x=rng.choice(_TOPICS[lang]), org=rng.choice(_ORGS[lang]), a=a, b=b, c=rng.choice("一二三四五六七八九"), l=rng.choice("abcdefg"), k=rng.randint(1, 28))

        def menu(lang: str = lang) -> list[str]:
            words = rng.sample(_WORDS[lang], min(len(_WORDS[lang]), rng.randint(3, 9)))
            join = rng.choice([" | ", " · ", "　", "  ", "\n", "\n"])
            return join.join(words).split("\n")

        def listing(lang: str = lang) -> list[str]:
            return [rng.choice(_HEADS[lang]), *[fill(rng.choice(_TITLES[lang])) for _ in range(rng.randint(1, 5))]]

        def long(lang: str = lang) -> list[str]:
            if rng.random() < 0.3:
                return [rng.choice([" | ", " · ", "　"]).join(rng.sample(_WORDS[lang] * 3, min(45, len(_WORDS[lang]) * 3)))]
            text = ""
            while len(text) <= 160:
                text += ("" if lang == "zh" or not text else " ") + fill(rng.choice(_LONG[lang]))
            return [text]

        def furniture(part: str, lang: str = lang) -> tuple[str, list[str]]:
            if rng.random() < 0.08:
                return "foot", long()
            pick = rng.randrange(8)
            if pick == 0:
                return "menu", menu()
            if pick == 1:
                return "side", listing()
            if pick == 2:
                return "crumb", [fill(rng.choice(_CRUMBS[lang]))]
            if pick == 3:
                return "menu", [rng.choice(_WORDS[lang])]
            return part, [fill(rng.choice(_LINES[lang]))]

        blocks: list[tuple[str, str, int]] = []
        add = lambda part, texts, label: blocks.extend((layout.get(part, ""), x, label) for x in texts)
        notice = lambda p: add("notice", [fill(rng.choice(_NOTICES[lang]))], NOTICE) if rng.random() < p else None
        whole = i % 2 == 0
        if whole:
            for _ in range(rng.randint(0, 4)):
                add(*furniture("menu"), FURNITURE)
            if rng.random() < 0.6:
                add("crumb", [fill(rng.choice(_CRUMBS[lang]))], FURNITURE)
            if rng.random() < 0.2:
                add(*furniture("menu"), FURNITURE)
        add("title", [fill(rng.choice(_TITLES[lang]))], MAIN)
        notice(0.4)
        if rng.random() < 0.55:
            add("body", [fill(rng.choice(_DOCNOS[lang]))], MAIN)
        notice(0.15)
        if rng.random() < (0.75 if lang == "zh" else 0.1):
            add("body", [rng.choice(_GREET[lang])], MAIN)
        mark, clauses = rng.choice(_MARKS[lang]), rng.choice((1, 3, 5, 7, 9))
        inside = rng.randrange(clauses) if whole and rng.random() < 0.5 else -1
        for j in range(clauses):
            text = " ".join(fill(rng.choice(_CLAUSES[lang])) for _ in range(rng.randint(1, 3)))
            add("body", [fill(mark) + (text.replace(" ", "") if lang == "zh" else text)], MAIN)
            if j == inside and j < clauses - 1:
                add(*(("side", listing()) if rng.random() < 0.67 else furniture("side")), FURNITURE)
            elif rng.random() < 0.05:
                notice(1)
        if rng.random() < 0.85:
            add("body", [fill(rng.choice(_SIGNS[lang]))], MAIN)
        notice(0.5)
        notice(0.3)
        if whole:
            for _ in range(rng.randint(1, 6)):
                add(*furniture("foot"), FURNITURE)
                notice(0.05)
        texts = [x for _, x, _ in blocks]
        if rng.random() < 0.2:  # wholly or partly read in the wrong encoding: its shapes are lost, its labels are not
            chain = rng.choice(CHAINS)
            a, b = sorted(rng.sample(range(len(texts) + 1), 2)) if rng.random() < 0.5 else (0, len(texts))
            texts[a:b] = [garble(x, chain) or x for x in texts[a:b]]
        pages.append(([(tags, x.replace("\n", " ")) for (tags, _, _), x in zip(blocks, texts, strict=True)], [y for _, _, y in blocks]))
    residue = [x for kind, own in EXEMPLARS.items() if kind != CLEAN for x in own] + ["{{title}}", "${body}", "undefined", "null", "[object Object]"]
    for _ in range(n // 12):  # whole texts of template residue or error messages are no pages
        some = rng.sample(residue, rng.randint(1, 4))
        pages.append(([("", x) for x in some], [MAIN] * len(some)))
    return pages


class Crf:
    """Weights of features and transitions between the three labels."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    def decode(self, page: list[tuple[int, ...]]) -> list[int]:
        """The most likely labels, by Viterbi."""
        w, t = self.weights, self.transitions.tolist()
        flat = np.fromiter((i for ids in page for i in ids), np.int64)
        ends = np.cumsum([len(ids) for ids in page])
        scores = np.add.reduceat(w[flat], np.concatenate([[0], ends[:-1]]), axis=0).tolist()
        best, back = scores[0], []
        for s in scores[1:]:
            step, now = [], []
            for y in range(3):
                a = [best[x] + t[x][y] for x in range(3)]
                k = a.index(max(a))
                step.append(k)
                now.append(a[k] + s[y])
            best = now
            back.append(step)
        y = best.index(max(best))
        labels = [y]
        for step in reversed(back):
            y = step[y]
            labels.append(y)
        return labels[::-1]


def train(pages: list[tuple[list[tuple[int, ...]], list[int]]], steps: int = STEPS, l2: float = 0.02, rate: float = 0.15) -> Crf:
    """Maximises the regularised log-likelihood with Adam; the forward-backward pass runs over all pages at once."""
    n, longest = len(pages), max(len(y) for _, y in pages)
    mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), np.int64)
    for i, (_, y) in enumerate(pages):
        mask[i, : len(y)], gold[i, : len(y)] = True, y
    flat = np.array([f for x, _ in pages for ids in x for f in ids])
    starts = np.cumsum([0, *[len(ids) for x, _ in pages for ids in x]])[:-1]
    owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(flat)]))
    w, t = np.zeros((1 << BITS, 3)), np.zeros((3, 3))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t)]
    onehot = np.eye(3)[gold] * mask[..., None]
    pair_gold = np.einsum("nla,nlb->ab", onehot[:, :-1], onehot[:, 1:])
    for step in range(1, steps + 1):
        e = np.zeros((n, longest, 3))
        e[mask] = np.add.reduceat(w[flat], starts, axis=0)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, longest):
            new = np.logaddexp.reduce(alpha[:, k - 1, :, None] + t, axis=1) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], new, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(mask[:, k + 1, None], new, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pairs = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        diff = (onehot - p)[mask]
        gw = np.stack([np.bincount(flat, diff[owner, y], 1 << BITS) for y in range(3)], axis=1)
        for x, g, s in ((w, gw - l2 * w, state[0]), (t, pair_gold - pairs.sum((0, 1)) - l2 * t, state[1])):
            s[0] += 0.1 * (g - s[0])
            s[1] += 0.01 * (g * g - s[1])
            x += rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-6)
    return Crf(w.astype(np.float32), t)


@functools.lru_cache(1)
def model() -> Crf:
    return train([(features([(tags, x.strip()) for tags, x in blocks]), labels) for blocks, labels in labelled_pages()])


def label_lines(text: str, crf: Crf) -> list[int]:
    """The label of each line of a text."""
    lines = [x.strip() for x in text.split("\n")]
    at = [i for i, x in enumerate(lines) if x]
    labels = [FURNITURE] * len(lines)
    if at:
        for i, y in zip(at, crf.decode(features([("", lines[i]) for i in at])), strict=True):
            labels[i] = y
    return labels


def label_html(page: str, crf: Crf) -> list[tuple[str, int]]:
    """The text and label of each leaf block of an HTML page; its ancestor tags are features."""
    from evidentia.llm.markup import _HIDDEN, _Page

    parser = _Page()
    parser.feed(page)
    parser.finish()
    blocks = [(" ".join(x.split(".")[0] for x in path[-2:]), " ".join(text.split())) for path, kind, text in parser.blocks if kind not in _HIDDEN]
    blocks = [x for x in blocks if x[1]]
    return [(text, y) for (_, text), y in zip(blocks, crf.decode(features(blocks)), strict=True)] if blocks else []


def _judged(text: str, crf: Crf, notices: set[str], least: int) -> list[int] | None:
    """The labels of the lines of a text that holds a whole page; None for other texts. Lines of `notices` are no main body, but
    no sign of a page either."""
    labels = label_lines(text, crf)
    lines = text.split("\n")
    if notices:
        labels = [NOTICE if y == NOTICE or line_key(x) in notices else y for x, y in zip(lines, labels, strict=True)]
    body, found = False, 0
    for line, y in zip(lines, labels, strict=True):
        line = line.strip()
        if y == FURNITURE and line and len(_ODD.findall(line)) * 4 < len(line) and not _GARBLED.search(line):
            found += 1
        elif y == MAIN and not body:
            body = coarse(line) in ("clause", "long", "sentence")
    return labels if body and found >= least else None


def _with_notices(df: DataFrame, key: str, text: str, source: str | None, notices: DataFrame | None) -> DataFrame:
    """k, t and the site's own repeated lines (notices: source, line) as an array."""
    picked = df.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("s"))
    if notices is None or source is None:
        return spread(picked).select("k", "t", F.array().cast("array<string>").alias("own"))
    own = cut(notices.select(F.col(source).cast("string").alias("s"), "line").groupBy("s").agg(F.collect_set("line").alias("own")))
    return spread(picked).join(small(own), "s", "left").select("k", "t", F.coalesce("own", F.array().cast("array<string>")).alias("own"))


def furniture_lines(df: DataFrame, key: str = "article_id", text: str = "text", least: int = 2, source: str | None = None, notices: DataFrame | None = None) -> DataFrame:
    """key and line number (from 1) of the lines that are not main body, in texts that hold a whole page.

    notices are lines (source, line) that each source repeats, as repeated_lines() gives them: where these are all that a text
    has besides its body, it holds no whole page.
    """
    docs = _with_notices(df, key, text, source, notices).where("k is not null and t <> ''")
    crf = model()

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, t, own in zip(b["k"], b["t"], b["own"], strict=True):
                for i, y in enumerate(_judged(t, crf, set(own), least) or (), 1):
                    if y != MAIN:
                        yield k, i

    return map_rows(docs, run, f"`{key}` {dict(docs.dtypes)['k']}, line_no long").distinct()


def main_bodies(df: DataFrame, key: str = "arrival", text: str = "text", least: int = 2, source: str | None = None, notices: DataFrame | None = None) -> DataFrame:
    """key and text; of a whole page only the main body."""
    docs = _with_notices(df, key, text, source, notices)
    crf = model()

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, t, own in zip(b["k"], b["t"], b["own"], strict=True):
                if t and (labels := _judged(t, crf, set(own), least)):
                    t = "\n".join(x for x, y in zip(t.split("\n"), labels, strict=True) if y == MAIN)
                yield k, t

    return map_rows(docs, run, f"`{key}` {dict(docs.dtypes)['k']}, `{text}` string")


def html_bodies(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, the main body of an HTML page by its leaf blocks and their ancestor tags, and the blocks left out."""
    docs = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    crf = model()

    def run(batches: Iterator[Columns]) -> Iterator[tuple]:
        for b in batches:
            for k, t in zip(b["k"], b["t"], strict=True):
                blocks = label_html(t, crf) if t else []
                yield k, None if t is None else "\n".join(x for x, y in blocks if y == MAIN), sum(y != MAIN for _, y in blocks)

    return map_rows(docs, run, f"`{key}` {dict(docs.dtypes)['k']}, body string, left_out int")
