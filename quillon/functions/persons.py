"""Functions on person and organisation surfaces and their aliases, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Compound surnames, nicknames' marks, suffixes and labels that results depend on.
COMPOUND = (
    "欧阳", "太史", "端木", "上官", "司马", "东方", "独孤", "南宫", "万俟",
    "闻人", "夏侯", "诸葛", "尉迟", "公羊", "赫连", "澹台", "皇甫", "宗政",
    "濮阳", "公冶", "太叔", "申屠", "公孙", "慕容", "仲孙", "钟离", "长孙",
    "宇文", "司徒", "鲜于", "司空", "闾丘", "子车", "亓官", "司寇", "巫马",
    "公西", "颛孙", "壤驷", "公良", "漆雕", "乐正", "宰父", "谷梁", "拓跋",
    "夹谷", "轩辕", "令狐", "段干", "百里", "呼延", "东郭", "南门", "羊舌",
    "微生", "公户", "公玉", "公仪", "梁丘", "公仲", "公上", "公门", "公山",
    "公坚", "左丘", "公伯", "西门", "第五", "淳于",
)
NICK_SUFFIX = ("哥", "姐", "叔", "总", "嫂", "爷")
BAD_SUFFIX = "案犯所部庭级记诉判书"
RIGHT_TOKENS = ("明知", "应知", "得知", "涉嫌", "供认", "供述", "陈述", "辩称", "表示", "承认", "否认", "不如实", "拒不", "依法", "予以", "被依法", "称其", "说到")
NO_PERSON = ("公司", "银行", "公安", "法院", "检察院")
COMMERCIAL = ("有限责任公司", "股份有限公司", "集团有限公司", "有限公司", "股份公司")
AGENCIES = ("公安分局", "公安局", "司法局", "派出所", "检察院", "人民法院", "法院", "讯问室", "看守所", "律师事务所", "人民政府", "委员会", "分局")
OBJECTS = ("银行卡", "信用卡", "身份证", "手机号", "账号", "卡号")
OBJECT_TAILS = ("卡", "账户", "账号", "号码", "手机", "设备", "证件")
ALIAS_LABELS = {
    "phone": "手机号", "phone_number": "手机号", "id_card": "身份证", "bank_card": "银行卡", "account": "账号",
    "imei": "设备", "ip": "IP", "address": "地址", "email": "邮箱", "organization": "单位",
}
# Surnames after which 老 and 小 are taken for a nickname; a parameter, the most frequent ones by default.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔"

CJK = r"[\x{4e00}-\x{9fff}]"
CJK_DOT = r"[\x{4e00}-\x{9fff}·]"


def _any(words) -> str:
    return "(" + "|".join(words) + ")"


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def surname(name: Column, surnames: str = SURNAMES) -> Column:
    """老王 and 小李 have their second letter; then compound surnames; then the first letter."""
    c = F.replace(_stripped(name), F.lit("·"), F.lit(""))
    compound = F.regexp_extract(c, "^" + _any(COMPOUND), 1)
    nick = (F.length(c) == 2) & _has(c, f"^[老小][{surnames}]")
    return F.when(nick, F.right(c, F.lit(1))).when(compound != "", compound).otherwise(F.left(c, F.lit(1)))


def variant_kind(name: Column) -> Column:
    """nick, anon, partial, full or other; nothing for an empty name."""
    c = _stripped(name)
    return (
        F.when(c == "", "")
        .when(_has(c, _any(NICK_SUFFIX) + "$") & (F.length(c) <= 4), "nick")
        .when(_has(c, f"^{CJK}{{1,2}}某{{1,2}}$"), "anon")
        .when(_has(c, f"^{CJK}{{1,2}}某{CJK}$"), "partial")
        .when(_has(c, f"^{CJK_DOT}{{2,4}}$"), "full")
        .otherwise("other")
    )


def alias_base(kind: Column, original: Column, surnames: str = SURNAMES) -> Column:
    """What an alias starts from: X某 for people, 尾号dddd and a label for the rest."""
    c = _stripped(original)
    plain = F.replace(c, F.lit("·"), F.lit(""))
    compound = F.regexp_extract(plain, "^" + _any(COMPOUND) + ".", 1)  # with a given name behind it
    nick = (F.length(plain) == 2) & _has(plain, f"^[老小][{surnames}]")
    own = F.when(nick, F.right(plain, F.lit(1))).when(compound != "", compound).otherwise(F.left(plain, F.lit(1)))
    person = F.when(c == "", "").when(_has(c, f"^{CJK_DOT}+$"), F.concat(own, F.lit("某"))).otherwise(F.concat(F.upper(F.left(c, F.lit(1))), F.lit("某")))
    label = F.coalesce(*(F.when(F.lower(kind) == k, F.lit(v)) for k, v in ALIAS_LABELS.items()), F.lit("信息"))
    d = F.regexp_replace(c, r"\D", "")
    other = F.when(F.length(d) >= 4, F.concat(F.lit("尾号"), F.right(d, F.lit(4)), label)).otherwise(F.concat(F.lit("某"), label))
    return F.when(F.lower(kind).isin("person", "name"), person).otherwise(other)


def looks_like_object(c: Column) -> Column:
    c = _stripped(c)
    return c.isin(*OBJECTS) | _has(c, f"^[这那该此][张个笔台部条只份枚]?.*{_any(OBJECT_TAILS)}$") | _has(c, "(张卡|该卡|此卡|本卡)$")


def person_ok(c: Column, excluded: tuple[str, ...] = ()) -> Column:
    """Whether a surface may be a person's: two to four letters, no legal word, object or agency."""
    some = F.regexp_extract(c, "^[^某]*某(.*)$", 1)
    ok = _has(c, f"^{CJK_DOT}{{2,4}}$") & ~_has(c, f"([{BAD_SUFFIX}]|{_any(RIGHT_TOKENS)}|{_any(NO_PERSON)})$") & ~looks_like_object(c)
    ok = ok & ~_has(c, f"^({_any(COMPOUND)}|{CJK}|[老小]{CJK}){_any(NICK_SUFFIX)}.+$")
    ok = ok & (~F.coalesce(c.contains("某"), F.lit(False)) | some.isin("", "某") | _has(some, f"^{CJK}$"))
    return ok & ~F.coalesce(c.isin(*excluded), F.lit(False)) if excluded else ok


def is_agency(c: Column) -> Column:
    c = _stripped(c)
    centre = _has(c, "中心$") & (_has(c, "办案|执法|公安|检察|司法|看守") | (_has(c, "法律") & _has(c, "援助")))
    return _has(c, f"({_any(AGENCIES)}|[局院所])$") | centre


def is_commercial(c: Column) -> Column:
    return ~is_agency(c) & _has(_stripped(c), _any(COMMERCIAL) + "$")


def organisation_ok(c: Column, excluded: tuple[str, ...] = ()) -> Column:
    s = _stripped(c)
    ok = (F.length(s) >= 2) & ~is_agency(c) & (~is_commercial(c) | (F.length(c) >= 4))
    return F.coalesce(ok & ~c.isin(*excluded) if excluded else ok, F.lit(False))


def trimmed_company(c: Column) -> Column:
    """The last company in a span that is too long."""
    word = r"[\x{4e00}-\x{9fff}·A-Za-z0-9]"
    found = F.regexp_extract_all(_stripped(c), F.lit(f"某{word}{{0,20}}{_any(COMMERCIAL)}|{word}{{2,20}}{_any(COMMERCIAL)}"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(_stripped(c))


def party_label(kind: Column, surface: Column, value: Column) -> Column:
    d = F.regexp_replace(_stripped(F.coalesce(F.nullif(value, F.lit("")), surface)), r"\D", "")
    tail = lambda lead, end, plain: F.when(F.length(d) >= 4, F.concat(F.lit(lead), F.right(d, F.lit(4)), F.lit(end))).otherwise(F.coalesce(F.nullif(surface, F.lit("")), F.lit(plain)))
    return (
        F.when(kind == "PHONE", tail("尾号 ", " 手机", "手机号码"))
        .when(kind == "ACCOUNT", tail("尾号 ", " 账户", "银行账户"))
        .when(kind == "DEVICE", tail("IMEI 尾号 ", " 设备", "电子设备"))
        .when(kind.isin("ORGANIZATION", "MERCHANT"), F.when(F.coalesce(surface, F.lit("")) != "", F.concat(F.lit("“"), surface, F.lit("”组织"))).otherwise("组织主体"))
        .otherwise(F.coalesce(F.nullif(surface, F.lit("")), F.lit("人物")))
    )


def masked_phone(c: Column) -> Column:
    """Eleven digits, without +86, hyphens and spaces, as 3****4; anything else as it is."""
    bare = F.replace(F.replace(F.replace(c, F.lit("+86"), F.lit("")), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))
    return F.when(_has(bare, "^[0-9]{11}$"), F.concat(F.left(bare, F.lit(3)), F.lit("****"), F.right(bare, F.lit(4)))).otherwise(c)


def chinese_number(n: Column) -> Column:
    """Whole numbers below ten thousand as clause numbers write them: 十二, 一百零五."""
    digit = lambda d: F.substr(F.lit("零一二三四五六七八九"), d + 1, F.lit(1))
    n = n.cast("int")
    part = lambda unit, name: F.when(F.floor(n / unit) % 10 > 0, F.concat(digit((F.floor(n / unit) % 10).cast("int")), F.lit(name))).otherwise(F.when(n >= unit, F.lit("零")).otherwise(F.lit("")))
    long = F.concat(part(1000, "千"), part(100, "百"), part(10, "十"), part(1, ""))
    long = F.regexp_replace(F.regexp_replace(long, "零+", "零"), "零+$", "")
    teen = F.concat(F.lit("十"), F.when(n % 10 > 0, digit(n % 10)).otherwise(""))
    return F.when(n == 0, "零").when(n < 10, digit(n)).when(n < 20, teen).otherwise(long)


def csv_set(c: Column) -> Column:
    """The distinct non-empty parts of a comma-separated string, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")))
