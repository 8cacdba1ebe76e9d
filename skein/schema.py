"""Row types and the fixed values of retrieval."""

from __future__ import annotations

from pyspark.sql import types as T

UNITS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("dependencies", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)
FILES = "path string, relative_path string, extension string, size bigint, mtime_ms double, content string"

# Scanning.
EXTENSIONS = [".js", ".ts", ".jsx", ".tsx", ".vue", ".json", ".md"]
PRUNED_DIRS = ["node_modules", "dist", "build", ".git", ".next", "coverage"]
DENIED_NAMES = [r"\.min\.js$", r"\.min\.css$", r"\.bundle\.js$", r"\.chunk\.js$", r"\.vendor\.js$", "(?i:swfupload)", "(?i:vconsole)", "(?i:zerocliboard)", "(?i:zclip)", r"(?i:jquery.*\.js$)", r"(?i:lodash.*\.js$)", r"(?i:moment.*\.js$)", r"(?i:animate.*\.js$)"]
TYPE_LABELS = {".js": "JavaScript", ".ts": "TypeScript", ".jsx": "React JSX", ".tsx": "React TSX", ".vue": "Vue组件", ".json": "JSON配置", ".md": "Markdown文档"}
DEFAULT_LABEL = "代码文件"
DEPENDENCY = r"""(?:import|require)\s*\(?['"]([^'"]+)['"]\)?"""

# Tokens, keywords and concepts.
CJK_RUN = "[一-龥]"
GENERIC_KEYWORDS = ["什么", "怎么样", "什么样", "如何", "怎么", "逻辑", "模块", "功能", "处理", "实现", "问题", "代码"]
KEYWORD_MAP = {
    "登录": ["login", "auth", "signin"], "注册": ["register", "signup"], "支付": ["pay", "payment", "checkout"], "订单": ["order"], "用户": ["user", "member"], "商品": ["product", "goods", "item"], "购物车": ["cart", "shopping"],
    "地址": ["address", "location"], "优惠券": ["coupon", "discount"], "小程序": ["miniprogram", "weapp"], "微信": ["wechat", "wx"], "外卖": ["takeout", "delivery", "waimai"], "模板": ["template", "tpl"], "配送": ["delivery", "shipping"],
    "骑手": ["rider", "courier"], "店铺": ["shop", "store"], "分类": ["category", "classify"], "搜索": ["search", "query"], "评价": ["review", "comment", "rating"], "收藏": ["favorite", "collect"], "分享": ["share"],
    "推广": ["promote", "promotion"], "分销": ["distribution", "dist"], "会员": ["member", "vip"], "积分": ["point", "credit"], "余额": ["balance", "wallet"], "退款": ["refund"], "售后": ["aftersale", "service"],
}
CONCEPT_MAP = {
    "加载": ["load", "fetch", "request", "init"], "流程": ["flow", "process", "handle"], "逻辑": ["logic", "handle", "process"], "详情": ["detail", "page"], "列表": ["list"],
    "活动": ["activity", "event", "activ"], "跳转": ["route", "navigate", "redirect"], "初始化": ["init", "initialize"], "获取": ["get", "fetch", "query"], "展示": ["render", "show", "display"],
}
BRIDGE_BLOCKED = ["function", "component", "default", "export", "const", "return", "async", "value", "false", "true", "null", "undefined", "object", "string", "number", "event", "target", "dataset", "utils", "index", "tool"]
BRIDGE_PATTERN = "(api|request|fetch|load|init|detail|activ|grouper|signup|route|flush)"

# Evidence (points and patterns on lower-case text).
EVIDENCE_TYPES = {"function": 120, "component": 100, "file": 20}
SRC_POINTS, DOCS_POINTS, GENERIC_FILE_POINTS, UTILS_POINTS, KEYWORD_POINTS = 80, -140, -120, -80, 25
GENERIC_FILE = r"^(tool|utils?|index|constant|constants)\.(js|ts|vue|md)$"
EVIDENCE_NAME = "api|load|get|set|fetch|beforeenter|init|filter|handle|show"
EVIDENCE_TEXT = "router|api/|setdata|vuex|watch|computed|template"
EVIDENCE_FLOW = "flush|load|init|request|fetch|query|detail|list"
EVIDENCE_CALL = r"await\s+\w*(api|request|fetch)|requestwithtoast|requestwithtoastcheck"

# Search defaults.
FETCH_FACTOR, DEFAULT_LIMIT, OUTLIER_RATIO, OUTLIER_SLACK = 2, 20, 2.2, 120.0
KEYWORD_WEIGHT, KEYWORD_LIMIT, HYBRID_BONUS, KEYWORD_ONLY_BASE, KEYWORD_BONUS = 10, 50, 40.0, 900.0, 45.0
TRUSTED_OVERLAP, TRUSTED_EXPANSIONS, TRUSTED_KEYWORDS, EXPANSION_WEIGHT = 0.2, 2, 16, 1.1
VOCABULARY_BOOST, LEAST_FREQUENCY = 200.0, 3
MMR_LAMBDA, COVERAGE_POINTS = 0.7, 40
CONTEXT_LIMIT, SNIPPET_CHARS, CHARS_PER_TOKEN = 32768, 1200, 2.5

# Text of prompts and answers.
BLOCK_SEPARATOR = "\n\n---\n\n"
CHAT_PROMPT = (
    "你是一个前端代码助手。请基于给定代码上下文回答用户问题。\n\n用户问题：\n{question}\n\n代码上下文：\n{context}\n\n回答要求：\n"
    "1. 只根据给定上下文回答，不能编造未出现的实现细节。\n2. 如果上下文不足，明确说\"当前上下文不足以确定\"，并说明还需要什么信息。\n3. 先给出简洁结论，再给出依据。\n4. 每条结论必须绑定至少一个来源编号（如：来源[1]、来源[2]）。\n"
    "5. 严格按以下结构输出：## 结论、## 证据、## 不确定项、## 建议。\n6. 如果提供了2个及以上来源，结论和证据应尽量覆盖至少2个不同来源。\n7. 不要输出代码块，不要写示例代码，不要补全上下文中没有出现的代码。\n8. 如果无法给出带来源的结论，请在“## 不确定项”中明确说明。\n"
)
STRICT_PROMPT = (
    "你上一版回答缺少有效来源编号。请重写并满足：\n1) 使用“## 结论 / ## 证据 / ## 不确定项 / ## 建议”四段。\n2) “## 结论”中每条结论必须包含来源编号（来源[1]...）。\n"
    "3) “## 证据”中至少列出2条来源映射（来源编号 + 证据点）。\n4) 只允许引用 1 到 {n} 的来源编号。\n5) 若证据不足，明确写“当前上下文不足以确定”。"
)
WIDER_PROMPT = "请确保：\n1) 结论和证据至少覆盖 2 个不同来源编号（若上下文不足则在“不确定项”说明）。\n2) 只允许引用 1 到 {n} 的来源编号。"
NO_CODE_PROMPT = "你上一版回答包含代码块。请重写并满足：\n1) 只输出事实结论，不要输出任何代码块（禁止 ```）。\n2) 每条结论必须绑定来源编号。\n3) 若上下文不足，请在“不确定项”说明，禁止脑补实现。"
REWRITE_PROMPT = (
    "将用户的自然语言问题改写成用于代码检索的查询串。要求：\n- 仅输出英文，禁止中文字符。\n- 输出多个英文关键词，空格分隔，覆盖模块、动作、对象等概念（如: weather is beautiful）。\n"
    "- 不要输出单个 camelCase 或 method.path 形式的标识符。\n- 仅输出改写结果，无前缀后缀无解释。\n- 如果中英文混杂，那么文本要分隔开"
)
FALLBACK_CONCLUSION = "{i}. 当前上下文可确认与问题相关的代码入口为 `{name}`（来源[{i}]）。"
FALLBACK_EVIDENCE = "{i}. 来源[{i}]：`{name}`（{type}），位置 `{file_path}:{start_line}-{end_line}`。"
FALLBACK_UNSURE = "当前上下文不足以完整还原“{question}”的全链路细节，仍需更多调用链/数据加载代码片段。"
FALLBACK_ADVICE = "建议补充同模块下的调用函数与数据请求函数后再生成完整流程结论。"
SUMMARY = "分析了 {n} 个相关代码片段，"
SUMMARY_HIGH, SUMMARY_MEDIUM, SUMMARY_NONE = "发现 {n} 个高可疑代码位置。", "发现 {n} 个中等可疑代码位置。", "未发现明确的可疑代码位置，建议人工检查。"

# Labels in the text of units.
LABEL_FILE, LABEL_SIGNATURE, LABEL_KIND, LABEL_NOTE, LABEL_CODE, LABEL_EXPORTED, LABEL_INTERNAL = "文件: ", "函数签名: ", "类型: ", "\n功能说明: ", "\n代码摘要:\n", "导出函数", "内部函数"
KIND_LABELS = {"function": "函数声明", "method": "类方法"}
KIND_DEFAULT = "箭头函数"
LABEL_PATH, LABEL_NAME, LABEL_CONTENT = "文件路径: ", "文件名: ", "代码内容:"

# Characters that displays show.
SHOWN_SEARCH, SHOWN_RERANK, SHOWN_ID, SHOWN_PATH, SHOWN_NUMBERS = 500, 300, 18, 38, 5
