"""The text operators against brute force, exact round trips or held-out accuracy."""

import random
import re
from collections import Counter

import pytest

WORDS = "港口 仓储 登记 结算 信贷 数据 共享 设备 租赁 风险 排查 年度 报表 合规 材料 单位 期限 审核 报送 记录 公开 通报 办理 机构 企业 平台 备案 资金".split()


def sentence(rng, n=12):
    return "".join(rng.choice(WORDS) for _ in range(n)) + "。"


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_garbled_text_comes_back(spark, monkeypatch, limit):
    from evidentia.llm import encodings
    from evidentia.llm.encodings import repaired

    monkeypatch.setattr(encodings, "TABLE", limit)  # as a table in the tasks, or joined value by value

    rng = random.Random(1)
    rows, truth = [], {}
    for i in range(400):
        text = "\n".join(sentence(rng) for _ in range(6))
        wrong = {7: ("utf-8", "latin-1"), 77: ("gb18030", "latin-1"), 177: ("utf-8", "mac_roman"), 277: ("gb18030", "big5")}.get(i)
        if wrong:
            truth[i] = text
            text = text.encode(wrong[0]).decode(wrong[1], "replace")
        rows.append((i, i, "标题", text))
    rows += [(500 + i, 500 + i, "Titre", f"L’été à Genève, numéro {i}. São Âncora garde ses accents.") for i in range(50)]
    rows.append((900, 900, "Titre", "L’été à Genève, numéro 51.".encode().decode("cp1252")))
    rows.append((901, 901, "Titre", "L�ét� à Genève"))
    found = {r.arrival: r for r in repaired(spark.createDataFrame(rows, "article_id long, arrival long, title string, text string")).collect()}
    assert set(found) == {*truth, 900, 901}
    assert [found[i].restored for i in (7, 77, 177)] == [truth[i] for i in (7, 77, 177)]
    assert found[900].restored == "L’été à Genève, numéro 51." and found[900].complete and not found[901].complete


@pytest.mark.parametrize("limit", [50_000, 0])
def test_repeated_lines_equal_brute_force(spark, monkeypatch, limit):
    from evidentia.llm import repeated_lines as module
    from evidentia.llm.repeated_lines import line_key, repeated_lines, without_lines

    monkeypatch.setattr(module, "SET_LINES", limit)  # as sets in the tasks, or joined

    rng = random.Random(2)
    rows = []
    for i in range(300):
        lines = [sentence(rng) for _ in range(5)] + rng.sample([f"阅读：{i}次", " 分享到：邮件　", "版权所有", "少见的行"], k=rng.randint(0, 3))
        rows.append((i % 280, i, "abc"[i % 3], "\n".join(lines)))
    held: dict = {}
    for k, _, s, t in rows:
        for x in {line_key(x) for x in t.split("\n")} - {""}:
            held.setdefault((s, x), set()).add(k)
    total = {s: len({k for k, _, x, _ in rows if x == s}) for s in "abc"}
    want = {(s, x) for (s, x), ks in held.items() if len(ks) >= 5 and len(ks) >= 0.15 * total[s]}
    df = spark.createDataFrame(rows, "article_id long, arrival long, source_key string, text string")
    for k in (4096, 16):  # summaries of any size lose nothing
        lines = repeated_lines(df, k=k)
        assert {(r.source_key, r.line) for r in lines.collect()} == want
    for r in without_lines(df, lines).collect():
        assert not {line_key(x) for x in r.text.split("\n")} & {x for s, x in want if s == "abc"[r.arrival % 3]}


def test_residue_and_talk_about_it(spark):
    from evidentia.llm.residue import residue, without_residue

    rng = random.Random(3)
    clean = [(i, "\n".join(sentence(rng) for _ in range(5))) for i in range(60)]
    clean += [(100, "门户提示“页面不存在”的，运营单位应当修复。" + sentence(rng)), (101, "Where a portal shows “page not found”, the operator must repair it.")]
    bad = [(200, "{{ doc.title }}\n{{doc.body}}"), (201, sentence(rng) + "[object Object]" + sentence(rng)), (202, sentence(rng) + "\n请启用浏览器脚本以查看附件内容。"), (203, "此处为示例文字，请在发布前替换。" * 3)]
    df = spark.createDataFrame(clean + bad, "article_id long, text string")
    assert {r.article_id for r in residue(df).collect()} == {200, 201, 202, 203}
    assert without_residue(df).count() == len(clean)


@pytest.mark.parametrize(
    ("body", "kinds", "part"),
    [
        ("<h2>标题</h2><ul><li>一</li></ul>", {"html"}, "## 标题\n- 一"),
        ("&lt;p&gt;text&lt;/p&gt;", {"html"}, "text"),
        ("## Head\n\n**bold** and [a](/b)", {"markdown"}, "## Head\nbold and a"),
        ("== Head ==\n[[a|b]] '''c'''\n* x\n* y", {"wiki"}, "## Head\nb c\n- x\n- y"),
        ("\\section{Head}\n\\textbf{x} 5\\%", {"latex"}, "## Head\nx 5%"),
        ("<p>$R=\\frac{P}{9}$</p>", {"html", "latex"}, "$R=\\frac{P}{9}$"),
        ("<pre><code>a = [1](2)</code></pre>", {"html"}, "```\na = [1](2)\n```"),
        ("费用为 $5 至 $9（含税*）。\n比例<80%且>50%的，列入C#类。\n字段名 risk_code_2 与 a*b", set(), "费用为"),
        ("<div><p>unclosed <b>tags", {"html"}, "unclosed tags"),
    ],
)
def test_markups(body, kinds, part):
    from evidentia.llm.markup import parse, render

    blocks, _, is_html = parse(body)
    assert {m for *_, marks in blocks for m in marks} | ({"html"} if is_html else set()) == kinds and part in render(blocks, set())


def test_repeated_branches_are_cut(spark):
    from evidentia.llm.markup import cleaned

    rng = random.Random(4)
    rows = [(i, f"<div class='body'><p>{sentence(rng)}</p></div><div class='foot'><p>联系我们 {i}</p></div>", "h") for i in range(40)]
    out = cleaned(spark.createDataFrame(rows, "docid long, docclob string, host string"), "docid", "docclob", "host").collect()
    assert all("联系我们" not in r.clean_text and len(r.clean_text) > 10 for r in out)


def test_only_furniture_is_cut(spark):
    """Over pages of three layouts with labelled parts: every repeated part goes, every own part stays."""
    from evidentia.llm.markup import cleaned, markups

    rng = random.Random(14)
    rows, own = [], {}
    for i in range(120):
        parts = [sentence(rng) for _ in range(3)]
        own[i] = parts
        host = "abc"[i % 3]
        body = "".join(f"<p>{x}</p>" for x in parts)
        head, foot = f"<div class='menu'><ul><li>首页{host}</li><li>**关于**</li></ul></div>", f"<div class='foot'><span>版权所有 {host} 第{i}号</span></div>"
        rows.append((i, [head + f"<article>{body}</article>" + foot, f"<div class='page'><div class='text'>{body}</div>{foot}</div>", f"<table><tr><td>{head}</td></tr></table><div class='main'>{body}</div>"][i % 3], host))
    df = spark.createDataFrame(rows, "docid long, docclob string, host string")
    out = {r.docid: r.clean_text for r in cleaned(df, "docid", "docclob", "host").collect()}
    assert all(x in out[i] for i, parts in own.items() for x in parts)
    assert not any("版权所有" in t or "首页" in t for t in out.values())
    # The menu's emphasis is the site's, not the record's.
    assert {(r.docid, r.markup) for r in markups(df, "docid", "docclob", "host").collect()} == {(i, "html") for i in own}


def test_crf_on_held_out_pages():
    from evidentia.llm.pages import features, labelled_pages, model

    crf, right, n = model(), 0, 0
    for blocks, labels in labelled_pages(100, seed=5):
        got = crf.decode(features([(tags, x.strip()) for tags, x in blocks]))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        n += len(labels)
    assert right / n > 0.96


def test_lookalikes(spark):
    from evidentia.llm.lookalikes import consistent, disguised

    plain = [(i, f"Under PHC-OAP/2023/{i} the café pays 12 crowns. 关于工作⼈员".replace("⼈", "人")) for i in range(5)]
    odd = [(10, "РНС-ОАР/2023/1"), (11, "the cafe\u0301 pays"), (12, "crо\u200bwns"), (13, "１２ crowns"), (14, "工作⼈员"), (15, "the\u00a0café")]
    fine = [(20, "Банк Северный Дом pays"), (21, "指标Ω与γ"), (22, "“引号”，全角标点：（一）")]
    df = spark.createDataFrame(plain + odd + fine, "id long, text string")
    assert {r.id for r in disguised(df, "id", ("text",)).collect()} == {i for i, _ in odd}
    out = {r.id: r.text for r in consistent(df, "id", "text").collect()}
    assert out[10] == "PHC-OAP/2023/1" and out[11] == "the café pays" and out[12] == "crowns" and out[13] == "12 crowns" and out[14] == "工作人员" and out[15] == "the café"
    assert all(out[i] == t for i, t in plain + fine)


@pytest.mark.parametrize("hot", [1000, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, hot):
    from evidentia.llm import near_duplicates
    from evidentia.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs

    monkeypatch.setattr(near_duplicates, "HOT", hot)

    rng = random.Random(6)
    texts = ["".join(sentence(rng, 14) for _ in range(20)) for _ in range(60)]
    rows = []
    for t in texts:
        rows.append((len(rows), t))
        for edits in (0, 2, 6, 12, 20, 40):
            x = list(t)
            for _ in range(edits):
                x[rng.randrange(len(x))] = rng.choice("甲乙丙丁")
            rows.append((len(rows), "".join(x) + " \n" * (edits == 0)))
    sets = {i: {x[j : j + 8] for j in range(len(x) - 7)} for i, t in rows if (x := re.sub(r"\s+", "", t).lower())}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(rows, "article_id long, text string")
    got = {tuple(r) for r in near_duplicate_pairs(df).collect()}
    assert not got - want and len(got) >= 0.99 * len(want)
    groups = {r.article_id: r.group_id for r in near_duplicate_groups(df).collect()}
    assert all(groups[i] == groups[j] for i, j in got)


def test_boilerplate_makes_no_pairs(spark):
    """A crowd of texts with half their length in common is hot in every probe, yet gives few candidates and no pairs."""
    from evidentia.llm import near_duplicates as nd

    rng = random.Random(9)
    common = "".join(sentence(rng, 14) for _ in range(12))
    rows = [(i, common + "".join(sentence(rng, 14) for _ in range(12))) for i in range(300)]
    _, classes = nd._signed_docs(spark.createDataFrame(rows, "article_id long, text string"), "article_id", "text", 8, 400)
    pairs = nd._hot_pairs(classes, classes.select("c"), 0.7, 1e-3)
    assert pairs.count() < 300 * 299 / 2 / 20


def test_leaks_equal_brute_force(spark):
    from evidentia.llm.leakage import fold, leaks

    rng = random.Random(7)
    items = [(i, "".join(sentence(rng, 20) for _ in range(4))) for i in range(30)]
    docs = []
    for i in range(200):
        t = "".join(sentence(rng) for _ in range(20))
        if i % 5 == 0:
            a = rng.randrange(60)
            t = t[:100] + items[i % 30][1][a : a + rng.randint(30, 90)] + t[100:]
        docs.append((i, t))
    want = set()
    for d, t in docs:
        t = fold(t)
        for i, x in items:
            x = fold(x)
            if any(x[p : p + 50] in t for p in range(len(x) - 49)):
                want.add((d, i))
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.where("leak = 'verbatim'").collect()} == want and want


def test_mixing_gives_shares(spark):
    from evidentia.llm.mixing import draws, entropy, plan, shares, tempered
    from evidentia.llm.queries import TOKENIZER

    rng = random.Random(8)
    docs = [(i, "a" if i % 3 else "b", " ".join(sentence(rng) for _ in range(3))) for i in range(3000)]
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 3)], "source string, target_share double, max_repeat int")
    drawn = draws(spark.createDataFrame(docs, "doc_id long, source string, text string"), targets, TOKENIZER)
    got = {r.source: r for r in shares(drawn, targets).collect()}
    assert abs(got["a"].actual_share - 0.4) < 0.002 and got["a"].most_uses == 1 and got["b"].most_uses <= 3
    # A budget that the caps forbid at the target shares lowers the exponent, and more entropy does too.
    weights, total = plan({"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2})
    assert weights == {"a": 0.5, "b": 0.5} and total == 400
    weights, _ = plan({"a": 1000, "b": 100}, {"a": 0.9, "b": 0.1}, {"a": 1, "b": 9}, least_entropy=0.5)
    assert 0.49 < entropy(weights) < 0.52 and tempered({"a": 0.9, "b": 0.1}, 0) == {"a": 0.5, "b": 0.5}


def test_pii_found_and_not(spark):
    from evidentia.llm.pii import find

    text = "联系人：欧阳逐溪，电话（0399）8270869转12，邮箱a.b+c@hub.test。住址砚湖新区望江街786号5单元899。身份证99492019540520327X。平台地址为10.3.35.70，账册编号412019067753787。"
    assert Counter(kind for _, _, kind in find(text)) == Counter({"name": 1, "phone": 1, "email": 1, "address": 1, "id_number": 1})
    english = "Contact: Ann B. Lee, tel. +44 20 7946 0191 ext. 3, a [at] b [dot] test. Batch 13143-72716-70222. She lives at Flat 2, 50 Quarry Road, Port Harrow QQ2 4ZZ. ID 666-79-2925. Tag @policydesk."
    assert [english[a:b] for a, b, _ in find(english)] == ["Ann B. Lee", "+44 20 7946 0191 ext. 3", "a [at] b [dot] test", "Flat 2, 50 Quarry Road, Port Harrow QQ2 4ZZ", "666-79-2925"]


@pytest.mark.parametrize("digits", ["7", "42", "0399", "15486350998", "0" * 18])
def test_feistel_round_trip(digits):
    from evidentia.llm.pii import check_digit, feistel, permuted_date, pseudonym

    key = b"k" * 32
    there = feistel(digits, key)
    assert len(there) == len(digits) and feistel(there, key, undo=True) == digits
    day = permuted_date("19880806", key)
    assert day[:2] == "19" and permuted_date(day, key, undo=True) == "19880806"
    number = pseudonym("994113 19880806 7504", "id_number", key)
    bare = number.replace(" ", "")
    assert re.fullmatch(r"\d{6} \d{8} \d{3}[\dX]", number) and check_digit(bare[:17]) == bare[17]
    assert len({feistel(f"{i:03d}", key) for i in range(1000)}) == 1000


@pytest.mark.parametrize("wrong", [("utf-8", "latin-1"), ("utf-8", "gb18030"), ("gb18030", "latin-1")])
def test_a_third_of_the_corpus_in_a_wrong_encoding(spark, wrong):
    from evidentia.llm.encodings import repaired

    rng = random.Random(8)
    rows, truth = [], {}
    for i in range(300):
        text = "\n".join(sentence(rng) for _ in range(4))
        if i % 3 == 0:  # one source of three: its characters are no rarer than those of the others
            truth[i] = text
            text = text.encode(wrong[0]).decode(wrong[1], "replace")
        rows.append((i, i, "标题", text))
    found = {r.arrival: r for r in repaired(spark.createDataFrame(rows, "article_id long, arrival long, title string, text string")).collect()}
    assert set(found) == set(truth)
    whole = [i for i in truth if "�" not in rows[i][3]]
    assert all(found[i].restored == truth[i] for i in whole)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_lines_pruned_from_every_summary_are_counted(spark, monkeypatch, limit):
    from evidentia.llm import repeated_lines as module

    monkeypatch.setattr(module, "SET_LINES", limit)
    # The line is in a fifth of the documents, but many others push it out of each summary.
    rows = [(i, i, "s", "\n".join([f"{'甲乙丙丁'[i % 4]}{chr(0x4E00 + i)}{chr(0x4E00 + j)}" for j in range(60)] + ["共有的行"] * (i % 5 == 0 and i < 280))) for i in range(300)]
    df = spark.createDataFrame(rows, "article_id long, arrival long, source_key string, text string")
    assert [(r.line, r.n_docs, r.n_source) for r in module.repeated_lines(df, k=16).collect()] == [("共有的行", 56, 300)]


def test_long_furniture_inside_the_body():
    from evidentia.llm.pages import FURNITURE, MAIN, label_lines, model

    clause = "A firm must lodge its papers on client money within 30 days, and the office may refuse the renewal."
    long = "This text concerns how a firm must keep its ledger, and the office may at any time ask for the papers that belong to it. " * 2
    cookies = "Our website stores cookies on your device to remember settings and to measure visits. You may accept or reject these cookies in the privacy settings of your browser. Read our cookie policy, imprint and terms of use for more."
    lines = ["Home | About | Notices | Contact", "Home > News > Notices", "Rules for client money", f"1. {clause}", f"2. {long.strip()}", cookies, f"3. {clause}", f"4. {clause}", "Privacy | Terms | Accessibility | Site map"]
    assert label_lines("\n".join(lines), model()) == [FURNITURE] * 2 + [MAIN] * 3 + [FURNITURE] + [MAIN] * 2 + [FURNITURE]


def test_html_bodies_by_dom_blocks(spark):
    """Pages whose words and layouts are not those of the training blocks: the tags must tell."""
    from evidentia.llm.pages import html_bodies

    clauses = ["Every ferry operator lists its vessels with the harbour office before the season starts.", "The harbour office may inspect a vessel at any time and bills the operator for it.", "Lists that are not up to date are sent back within ten days."]
    body = "".join(f"<p>{i}. {x}</p>" for i, x in enumerate(clauses, 1))
    head, foot = "<ul><li>Harbour</li><li>Vessels</li><li>Tides</li></ul>", "<p>Quay 4, Old Town</p><p>Opening hours</p>"
    pages = [
        f"<html><body><nav>{head}</nav><main><h1>Ferry lists</h1>{body}</main><aside><ul><li>Tide tables 2024</li><li>Crane hire</li></ul></aside><footer>{foot}</footer></body></html>",
        f"<header>{head}</header><article><h2>Ferry lists</h2>{body}</article><footer><div>Quay 4, Old Town</div><div>Opening hours</div></footer>",
        None,
        "",
    ]
    rows = {r.id: r for r in html_bodies(spark.createDataFrame(list(enumerate(pages)), "id long, page string"), "id", "page").collect()}
    for i in (0, 1):
        assert all(x in rows[i].body for x in clauses) and not any(x in rows[i].body for x in ("Tides", "Opening hours", "Crane hire"))
    assert rows[2].body is None and rows[3].body == ""


def test_notices_alone_are_no_page(spark):
    from evidentia.llm.pages import furniture_lines

    clause = "从事危险货物运输的单位应当在3月1日前报送有关材料，逾期不报的，依法处理。"
    plain = "\n".join(["关于加强港口管理的意见", f"一、{clause}", f"二、{clause}", "某某市财政局　2021年3月1日", "来源：港口网　浏览次数：7", "扫描二维码关注港口网"])
    page = "首页 | 新闻 | 公告 | 搜索\n首页 > 新闻 > 公告\n" + plain + "\n联系方式 | 法律声明 | 隐私政策\nICP备案号：77"
    rows = spark.createDataFrame([(1, "s", plain), (2, "s", page), (3, None, page)], "article_id long, source_key string, text string")
    notices = spark.createDataFrame([("s", "来源：港口网　浏览次数：#"), ("s", "扫描二维码关注港口网")], "source_key string, line string")
    found = {(r.article_id, r.line_no) for r in furniture_lines(rows, source="source_key", notices=notices).collect()}
    assert found == {(2, i) for i in (1, 2, 7, 8, 9, 10)} | {(3, i) for i in (1, 2, 7, 8, 9, 10)}


def test_the_exponent_is_the_largest_that_serves():
    """Against a search over a fine grid: shares, caps and budgets at random."""
    import warnings

    from evidentia.llm.mixing import plan, tempered

    rng = random.Random(12)
    for _ in range(100):
        tokens, given = {s: rng.randint(10, 2000) for s in "abcd"}, {s: rng.random() for s in "abcd"}
        caps, budget = {s: rng.randint(1, 4) for s in "abcd"}, rng.uniform(0.2, 1.2) * 4000
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            weights, total = plan(tokens, given, caps, budget=budget)
        serves = [e / 1000 for e in range(1001) if all(w * budget <= caps[s] * tokens[s] for s, w in tempered(given, e / 1000).items())]
        if serves:
            best = tempered(given, max(serves))
            assert abs(total - budget) < 1e-3 * budget and max(abs(best[s] - weights[s]) for s in best) < 5e-3
        else:
            assert total < budget


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("我叫陈伟，住在这里。", ["陈伟"]),
        ("Mein Name ist Hans Müller.", ["Hans Müller"]),
        ("Yours sincerely, Tomasz Kowalski", ["Tomasz Kowalski"]),
        ("He lives at 14 Elmhurst Rise, Leeds LS6 2AB now.", ["14 Elmhurst Rise, Leeds LS6 2AB"]),
        ("地址：北京市海淀区建国路88号院3号楼1201", ["北京市海淀区建国路88号院3号楼1201"]),
        ("本人提交的材料于3月送达。", []),
        ("Rule 14 Elmhurst Rise applies to Leeds.", []),
    ],
)
def test_contexts_of_names_and_addresses(text, found):
    from evidentia.llm.pii import find

    assert [text[a:b] for a, b, _ in find(text)] == found


def test_birth_dates_and_insurance_keys_stay_valid():
    import datetime

    from evidentia.llm.pii import births_permuted, pseudonym

    key = b"k" * 32
    out = births_permuted("出生日期：1980年3月12日；born on 12 March 1980; geboren am 12.03.1980; issued on 12 March 1980", key)
    m = re.fullmatch(r"出生日期：(\d{4})年(\d+)月(\d+)日；born on (\d+) (\w+) (\d{4}); geboren am (\d\d)\.(\d\d)\.(\d{4}); issued on 12 March 1980", out)
    assert m and datetime.date(int(m[1]), int(m[2]), int(m[3])) == datetime.date(int(m[9]), int(m[8]), int(m[7])) != datetime.date(1980, 3, 12) and m[1] == m[6] and m[3] == m[4]
    nir = pseudonym("1 80 03 75 123 456 05", "id_number", key).replace(" ", "")
    assert int(nir[13:]) == 97 - int(nir[:13]) % 97 and nir[0] == "1"


def test_a_letter_beyond_the_table_reaches_the_vocabulary(spark):
    from evidentia.llm.lookalikes import canonical, consistent, Trie

    plain = [(i, "annual settlement report") for i in range(4)]
    df = spark.createDataFrame([*plain, (9, "annual settleжent report"), (10, "2 μm and Δt")], "id long, text string")
    out = {r.id: r.text for r in consistent(df, "id", "text").collect()}
    assert out[9] == "annual settlement report" and out[10] == "2 μm and Δt"
    trie = Trie()
    trie.add("settlement", 3)
    assert canonical("settleжent", trie) == "settlement" and canonical("sжttleжent", trie) == "sжttleжent"


def test_paraphrased_leaks(spark):
    """Labelled paraphrases: sentences in another order, one word in eight replaced, inside other text. Their recall is measured."""
    from evidentia.llm.leakage import leaks

    rng = random.Random(21)
    items = [[sentence(rng, 14) for _ in range(4)] for _ in range(40)]

    def reworded(text):
        words = re.findall("|".join(WORDS), text)
        return "".join(rng.choice(WORDS) if rng.random() < 0.125 else w for w in words) + "。"

    docs = []
    for i, parts in enumerate(items):
        head = parts[:3]
        rng.shuffle(head)
        docs.append((i, "".join([sentence(rng, 30), *map(reworded, head), reworded(parts[3]), sentence(rng, 30)])))
    docs += [(100 + i, "".join(sentence(rng, 14) for _ in range(6))) for i in range(100)]
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(items)], "item_id long, text string"), share=0.3)
    pairs = {(r.doc_id, r.item_id) for r in found.collect()}
    right = {(i, i) for i in range(40)}
    print("paraphrases found", len(pairs & right), "of 40, wrong", len(pairs - right))
    assert len(pairs & right) >= 32 and len(pairs - right) <= 2


def test_near_duplicates_in_rounds_leave_little_on_disk(spark, monkeypatch):
    """Partitions and pairs in many rounds give the same pairs, and of the signatures one table stays."""
    import os

    from evidentia.llm import near_duplicates as nd
    from evidentia.session import run_dir

    rng = random.Random(11)
    rows = [(i, "".join(sentence(rng, 14) for _ in range(28))) for i in range(1500)]
    rows += [(2000 + i, "甲乙丙丁" + t[:-20]) for i, t in rows[:40]]
    df = spark.createDataFrame(rows, "article_id long, text string")
    size = lambda: sum(os.path.getsize(f"{d}/{x}") for d, _, files in os.walk(run_dir(spark)) for x in files)
    before = size()
    got = {tuple(r) for r in nd.near_duplicate_pairs(df).collect()}
    assert got == {(i, 2000 + i) for i in range(40)} and size() - before < 1.7 * 4 * nd.POSITIONS * len(rows)
    monkeypatch.setattr(nd, "ROUND", 80_000)
    monkeypatch.setattr(nd, "PAIRS", 20)
    assert {tuple(r) for r in nd.near_duplicate_pairs(df).collect()} == got


def test_garbled_values_are_the_same_joined_or_by_table(spark, monkeypatch):
    """A token known from another value is found inside a longer one; values whose lines need no match, or hold lost bytes, stay."""
    from evidentia.llm import encodings
    from evidentia.llm.encodings import repaired

    rows = [(i, i, "Titre", f"note {i} aé‘b et à é‘ ici") for i in range(60)]
    bad = "é‘".encode().decode("cp1252")
    rows += [(100, 100, "Titre", f"voir {bad} ici"), (101, 101, "Titre", f"voir x{bad}yz ici"), (102, 102, "Titre", "L’été à Genève".encode().decode("cp1252")), (103, 103, "Titre", "L\ufffdt\ufffd")]
    df = spark.createDataFrame(rows, "article_id long, arrival long, title string, text string")
    monkeypatch.setattr(encodings, "TABLE", 1_000_000)
    table = sorted(map(tuple, repaired(df).collect()))
    monkeypatch.setattr(encodings, "TABLE", 0)
    assert sorted(map(tuple, repaired(df).collect())) == table and {102, 103} <= {r[0] for r in table}


def test_joined_values_look_up_what_the_scan_does():
    from evidentia.llm.encodings import _lookups, _scan

    class Asked(dict):
        def __contains__(self, x):
            asked.add(x)
            return False

    for line in ("xÃ©bÃ z-â€™Ã©tat d’été", "中Ã©a文b 银行Ã¤", "ÃaÃbÃcÃ"):
        asked: set[str] = set()
        odd = set("Ã©¤€")
        _scan(line, odd, Asked())
        assert {x for x in asked if not odd.isdisjoint(x)} <= _lookups(line, odd)


def test_few_plain_lines_are_encoded(monkeypatch):
    """Most lines are told from garbled ones by the ends of their runs, without a trial of the encodings."""
    from evidentia.llm import encodings

    rng, whole, encode = random.Random(12), [], encodings._encode
    lines = [f"{i} {sentence(rng)}" for i in range(400)]
    monkeypatch.setattr(encodings, "_encode", lambda text, name: whole.append(text) if len(text) > 1 and text in lines else encode(text, name))
    assert not any(encodings.unread(x) is not None for x in lines) and len(whole) < len(lines) / 2
