"""Fixed values that results depend on: templates, patterns, weights and word lists."""

# BM25 and fusion constants.
BM25_K1 = 1.5
BM25_B = 0.75
RRF_K = 60
ROUTE_DEPTH = 20
TOP_K = 5
VECTOR_THRESHOLD = 0.0
ZERO_NORM = 1e-9

# Admission and length gates.
MIN_CHUNK_CHARS = 15
MIN_PAGE_CHARS = 100
SEARCHABLE_TYPES = ("human_markdown", "web_reviewed", "user_registered")
SOURCE_TYPES = ("human_markdown", "web_candidate", "web_reviewed", "ai_draft", "user_registered")
INGEST_STATUSES = ("candidate", "approved", "rejected")
SKIPPED_FOLDERS = ("_templates", "_inbox")
KNOWN_COURSES = ("os", "ds", "co")

# Characters dropped before comparing titles, contents and answers.
TITLE_DROPPED = "，。、；：？！\"'《》（）()[]{}"
CONTENT_DROPPED = TITLE_DROPPED + "-#*>`"
ANSWER_DROPPED = r"(?U)[，。！？、；：:“”‘’'\".,!?;:()\[\]{}<>\s]"

# Characters a file name stem drops, and those it turns into dashes; its length.
STEM_DROPPED = "（）()《》<>「」【】[]{}"
STEM_DASHED = "，。、；："
STEM_CHARS = 50

# Elements that hold a page's main text, in order of preference; words of a class that mark one; noise.
MAIN_ELEMENTS = ("article", "main")
MAIN_CLASS_WORDS = ("content", "post", "article", "entry")
NOISE_ELEMENTS = ("script", "style", "nav", "footer", "header", "aside")

# Markers of worked examples in notes.
EXAMPLE_SECTION = "## 经典例题"
EXAMPLE_QUESTION = "**题干**"
EXAMPLE_ANSWER = "**解答**"

# Difficulty levels with minutes and priority.
DIFFICULTY_MINUTES = {"入门": 25, "中等": 35, "进阶": 50}
DIFFICULTY_PRIORITY = {"入门": "low", "中等": "medium", "进阶": "high"}
DEFAULT_DIFFICULTY = "中等"
DEFAULT_MINUTES = 35
DEFAULT_PRIORITY = "medium"
REVIEW_BUFFER_MINUTES = 10
DEFAULT_PLAN_DAYS = 14

# Spaced repetition intervals in days.
INTERVAL_DAYS = (1, 2, 4, 8, 16, 32)

# Grading.
COVERAGE_THRESHOLD = 0.55
MAX_ATTEMPTS = 2
FIRST_TRY_SCORE = 1.0
SECOND_TRY_SCORE = 0.6

# Question templates for concept questions.
CONCEPT_TEMPLATES = (
    "{tag}是什么？简述其核心概念。",
    "请解释{tag}的原理和作用。",
    "{tag}在实际系统中是如何应用的？",
    "比较{tag}与相关概念的区别。",
)

# Texts shown to the learner.
UNTITLED_PAGE = "未命名条目"
NO_HIT_ANSWER = (
    "（知识库中暂无相关内容。请先在 knowledge/ 补充该主题的笔记，"
    "或查看 docs/reference/ 中的外部资料索引。）"
)
SUMMARY_HEAD = "以下内容取自你的知识库笔记，可作复习参考："
HINT_FORMAT = "提示：%s 请结合出处再答一次。"
HINT_FALLBACK = "请结合讲解和来源笔记再答一次。"
FULL_REFERENCE = "完整参考："
RELATED_PLACEHOLDER = "- （待补充关联条目链接）"
REVIEW_MESSAGE = "已记录复习（第 %d 次），下次复习：%s（%d 天后）"

# Headings of a structured note and the headings they are filled from.
HEAD_TLDR = "## 一句话概括（TL;DR）"
HEAD_CORE = "## 核心概念"
HEAD_PRINCIPLE = "## 关键原理 / 算法"
HEAD_PITFALLS = "## 易错点 / 高频考点"
HEAD_RELATED = "## 关联条目"
TLDR_KEYS = ("TL;DR", "一句话概括")
CORE_KEYS = ("核心概念", "概述")
PRINCIPLE_KEYS = ("关键原理", "算法", "原理")
PITFALL_KEYS = ("易错点", "高频考点", "注意事项")

# Characters Python counts as white space, so that trimming agrees with it.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
