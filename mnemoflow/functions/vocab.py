"""Fixed vocabularies and constants. All are parameters of the functions that use them; these are the defaults."""

#: Terms that are recognised as entities (case-insensitive substrings). Names of one's own products are passed in.
ENTITY_TERMS = (
    "python", "javascript", "typescript", "react", "vue", "vite", "webpack",
    "node", "nodejs", "lancedb", "sqlite", "postgres", "mysql",
    "fastapi", "flask", "django", "express", "nextjs", "nuxt",
    "bge-m3", "embedding", "rerank", "rag", "fts5",
    "sap", "fico", "co", "rfc", "abap",
    "remotion", "imagegen", "skill",
    "windows", "linux", "macos", "wsl", "git", "github",
)

#: Terms that keep a chunk which is too short otherwise.
KEY_TERMS = (
    "rag", "rrf", "bm25", "fts5", "lancedb", "sqlite",
    "bge-m3", "embedding", "rerank", "reranker",
    "hyde", "query rewrite", "时间衰减", "去重",
    "向量检索", "语义检索", "关键词检索", "混合检索",
    "元数据", "融合", "嵌入", "向量",
    "lance", "ann", "hnsw", "ivf",
    "watchdog", "daemon", "ingest", "dedup", "retriever",
)

#: Headings that are never a project's name.
GENERIC_HEADINGS = (
    "项目背景", "技术决策", "评分维度", "现有架构", "已知问题",
    "优化目标", "技术选型", "去重策略", "时间衰减", "快速开始",
    "项目结构", "关键设计", "配置项", "已知限制", "环境说明",
    "下一步", "守护进程", "完整产物清单",
    "测试", "结果", "结论", "建议", "问题", "回答",
    "背景", "决策", "架构", "目标", "选型",
    "summary", "background", "requirements", "design",
    "implementation", "testing", "results", "discussion",
)

#: Words that raise a chunk's confidence (one ends in a space).
DECISION_WORDS = ("决定", "弃用", "采用", "用 ", "不用", "失败", "成功")

#: Words of the relabelling rules.
RELABEL_DECISION_WORDS = ("决定", "弃用", "采用", "不用", "失败", "成功", "选用", "选择", "禁用", "改用")
RELABEL_TEST_WORDS = ("验证", "召回", "实测", "测试通过", "pytest", "PASSED", "FAILED")

#: Keys of an embedded JSON block that come first, in this order.
PRIORITY_KEYS = ("memory_type", "summary", "key_facts", "facts", "decisions", "preferences", "tags", "topics")
#: Keys that mark a block as a profile copy.
PROFILE_KEYS = ("uid", "memoryBlock", "memory_type")
BLOCK_START, BLOCK_END = "<!-- RAW_JSON_START -->", "<!-- RAW_JSON_END -->"

#: Words and pronouns that show that a query is about the past.
HISTORY_WORDS = (
    "之前", "上次", "上次聊", "前几天", "昨天", "前天",
    "记得", "还记得", "你记不记得", "提过", "聊过", "说过",
    "那时候", "那一次", "当时", "去年", "上月",
    "以前", "过往", "曾经", "过去",
)
HISTORY_PRONOUNS = ("我", "咱", "你")

#: Query rewriting templates.
REWRITE_TEMPLATES = ("关于「{query}」的说明：", "「{query}」的定义和用途：", "以下是「{query}」的相关信息：")

#: Level of detail of each source; others are full.
SOURCE_LEVELS = {"user-memory": "summary"}
NO_PROJECT = "(未分类)"

#: Which note files are read, and which names are left out.
NOTE_PATTERNS = ("*_memory.md", "MEMORY.md", "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]*.md")
IGNORE_PATTERNS = (
    "*.bak", "*.tmp.*", "*~", "*.swp", ".DS_Store",
    "README.md", "CHANGELOG.md", "SKILL.md", "INSTALL.md",
    "TROUBLESHOOTING.md", "LICENSE.md", "CONTRIBUTING.md",
)
