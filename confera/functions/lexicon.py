"""Word lists and patterns as data: one set for Chinese conversations, one for the synthetic test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from confera.functions.text import first_of


@dataclass(frozen=True)
class Lexicon:
    #: (pattern, label, domain, confidence in hundredths), first match counts; the last is the default, without a pattern.
    domains: tuple[tuple[str, str, str, int], ...]
    compatible: frozenset[tuple[str, str]]
    #: (keyword, weight), first in the list counts.
    keywords: tuple[tuple[str, float], ...]
    question: str
    continuation: str
    switch: str
    negative_break: str
    practice: str
    assistant_wrap: str
    wrap_up: str
    negative: str
    positive: str
    empathy: str
    preachy: str
    dimension_empathy: str
    dimension_preachy: str
    confusion: str
    resolution_signal: str
    escalation_signal: str
    case_escalation: str
    goal_resolution: tuple[str, ...]
    goal_appreciation: tuple[str, ...]
    goal_give_up: tuple[str, ...]
    goal_escalation: tuple[str, ...]
    goal_failure: tuple[str, ...]
    apology: tuple[str, ...]
    rephrase: tuple[str, ...]
    clarification: tuple[str, ...]

    def domain(self, content: Column) -> Column:
        """struct(label, domain, confidence in hundredths) of a message."""
        value = lambda label, name, hundredths: F.struct(F.lit(label).alias("label"), F.lit(name).alias("domain"), F.lit(hundredths).alias("hundredths"))
        return first_of([(content.rlike(p), value(*rest)) for p, *rest in self.domains[:-1]], value(*self.domains[-1][1:]))

    def keyword(self, content: Column) -> Column:
        """struct(keyword, weight) of the first listed keyword in the text, else null."""
        value = lambda k, w: F.struct(F.lit(k).alias("keyword"), F.lit(w).alias("weight"))
        return first_of([(F.contains(content, F.lit(k)), value(k, w)) for k, w in self.keywords], F.lit(None).cast("struct<keyword:string,weight:double>"))


def any_of(content: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | content.rlike(p)
    return out


# The patterns and lists for Chinese conversations.
ZH = Lexicon(
    domains=(
        ("(守夜人|蒸汽城|钟楼|钥匙|守卫|旅者|铜门|档案室|地图)", "剧情角色扮演", "story_roleplay", 95),
        ("(扮演|练习|模拟|台词|回答|口令|重复|样本小|备用方案)", "训练演练", "practice", 92),
        ("(失眠|闭眼|胸口|四拍呼吸|焦虑|停不下来)", "失眠与焦虑安抚", "anxiety_relief", 91),
        ("(主管|方案|汇报|客户|项目|工作|复盘|转化|否定|逻辑散)", "工作压力与沟通", "work_stress", 90),
        ("(模板|明天|休息|下次|记录|关掉手机|最后一步|继续钟楼线)", "行动收尾", "wrap_up", 88),
        ("(难受|怀疑|委屈|很差|不行|害怕|信任|陪你|支持|正常)", "情绪倾诉与安抚", "emotion_support", 82),
        ("", "开场连接", "casual", 42),
    ),
    compatible=frozenset(
        pair
        for a, b in (("work_stress", "emotion_support"), ("anxiety_relief", "emotion_support"), ("casual", "emotion_support"), ("practice", "work_stress"), ("practice", "emotion_support"), ("story_roleplay", "casual"))
        for pair in ((a, b), (b, a))
    ),
    keywords=(
        ("错了", 0.34), ("不对", 0.32), ("不是", 0.22), ("不行", 0.32), ("重来", 0.32), ("换一个", 0.24), ("没用", 0.32), ("无效", 0.32),
        ("答非所问", 0.36), ("没回答", 0.32), ("没解决", 0.34), ("听不懂", 0.24), ("看不懂", 0.22), ("没明白", 0.24), ("什么意思", 0.22), ("太慢", 0.24),
        ("等太久", 0.24), ("反复", 0.22), ("重复", 0.2), ("麻烦", 0.14), ("烦", 0.14), ("崩溃", 0.36), ("生气", 0.24), ("投诉", 0.38),
        ("转人工", 0.36), ("找主管", 0.34), ("客服不行", 0.34), ("别敷衍", 0.26), ("别绕", 0.22), ("别废话", 0.24), ("没有帮助", 0.32), ("不满意", 0.32),
    ),
    question="[?？]",
    continuation="(继续|接着|上次|还记得|再来一次|今晚继续|刚才|那个故事)",
    switch=r"(这个|上面|刚才|还有|另外|再问|换个|ok\s*那|OK\s*那)",
    negative_break="(错了|不对|不是|不行|重来|换一个|没回答|没解决|答非所问)",
    practice="(扮演|练习|模拟|继续讲|剧情|口令|模板|先找|先读)",
    assistant_wrap="(模板|最后一步|下次|关掉手机|继续钟楼线)",
    wrap_up="(模板|最后一步|明天|休息|下次|关掉手机|继续钟楼线)",
    negative="(害怕|怕|焦虑|担心|不行|失眠|难受|怀疑|委屈|低落|很差|卡壳|糟糕|被批评|被否定|胸口闷)",
    positive="(谢谢|很好|很棒|清楚|信任|放松|稳定|成长|支持|完美|喜欢|没那么闷|成熟|礼貌又专业)",
    empathy="(理解|明白|陪你|正常|辛苦|收到|我们先不急|我在这里|慢下来)",
    preachy="(应该|必须|你要|一定要|立刻|马上)",
    dimension_empathy="(理解|明白|支持|陪你|辛苦|正常)",
    dimension_preachy="(应该|必须|你要|一定要)",
    confusion="(什么意思|不懂|你是说|再说一遍|没明白|怎么理解)",
    resolution_signal="(已(经)?(为您|帮您)?(处理|提交|安排|登记|解决)|预计.*(回复|发出)|工单号|已提交权限申请|补发|退款)",
    escalation_signal="(转人工|投诉|主管|经理|升级专员|人工复核|工单)",
    case_escalation="(转人工|投诉|主管|经理|升级专员)",
    goal_resolution=("(已经?为您|已[帮给]您)(处理|安排|解决|提交|下单|发送|操作)", "(这就|马上|立刻)(帮您|给您|为您)(处理|安排|操作)", "(已完成|已解决|已搞定|已结束|问题已经?解决)", "(办好了|弄好了|处理好了|完成了|搞定了)"),
    goal_appreciation=("(?i)^(好的|行|ok|可以|谢谢|多谢|感谢|辛苦了|收到|明白了)", "(谢谢|感谢|辛苦)"),
    goal_give_up=("^(算了|不用了|不聊了|不想再|放弃)", "(别说了|不要再|浪费时间)"),
    goal_escalation=("(转人工|找客服|投诉|经理|主管)",),
    goal_failure=("(还是不行|没解决|解决不了|没有用|搞不定|完全不对)", "(你不明白|你没听懂|答非所问|驴唇不对马嘴)"),
    apology=("(抱歉|不好意思|对不起|让你困扰了)", "(?i)(sorry|apologize)"),
    rephrase=("(换个说法|我换个方式|重新解释|重新说明)", "(?i)(let me rephrase|let me explain differently)"),
    clarification=("(我先确认一下|我理解的是|你是想说)", "(?i)(let me confirm|if i understand correctly)"),
)


def _words(*words: str) -> str:
    """Whole words of the synthetic texts; a syntax that Java, RE2 and Python read alike."""
    return f"(^|[^A-Za-z])({'|'.join(words)})($|[^A-Za-z])"


#: For the generated test tables, whose texts are made of invented words: the roles are dealt to words by their frequency.
SYNTHETIC = Lexicon(
    domains=((_words("erin", "than"), "story", "story_roleplay", 95), (_words("thre", "tion"), "practice", "practice", 92), (_words("are"), "anxiety", "anxiety_relief", 91), (_words("this"), "work", "work_stress", 90), (_words("from"), "wrap", "wrap_up", 88), (_words("with"), "support", "emotion_support", 82), ("", "casual", "casual", 42)),
    compatible=ZH.compatible,
    keywords=((" onon ", 0.34), (" erst ", 0.32), (" thst ", 0.22), (" than ", 0.24), (" erin ", 0.14)),
    question=_words("was", "that"),
    continuation=_words("for"),
    switch=_words("thst", "thre"),
    negative_break=_words("erst"),
    practice=_words("tion"),
    assistant_wrap=_words("from"),
    wrap_up=_words("from", "than"),
    negative=_words("erst", "thst", "onon", "thre"),
    positive=_words("with", "from"),
    empathy=_words("for", "are"),
    preachy=_words("than"),
    dimension_empathy=_words("for", "are", "with"),
    dimension_preachy=_words("than", "this"),
    confusion=_words("onon", "erin"),
    resolution_signal=_words("from", "tion"),
    escalation_signal=_words("erin", "thst"),
    case_escalation=_words("erin"),
    goal_resolution=(_words("from"), _words("tion")),
    goal_appreciation=(_words("with"), _words("are")),
    goal_give_up=(_words("than"),),
    goal_escalation=(_words("erin"),),
    goal_failure=(_words("onon"), _words("thst")),
    apology=(_words("with"),),
    rephrase=(_words("this"),),
    clarification=(_words("are"),),
)
