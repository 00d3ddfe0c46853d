"""Word lists, thresholds and tables that results depend on. All are parameters elsewhere."""

HIGH_VALUE = ("财报", "earnings", "10-k", "招股", "prospectus", "合同", "contract", "标准", "jedec", "semi", "白皮书", "techbrief", "annual report", "法说")
LOW_VALUE = ("草稿", "draft", "转发", "fwd:", "re:", "邮件", "便签", "note")
ENTITY_HINTS = ("n3", "n5", "n2", "euv", "duv", "hbm", "jesd", "代工厂", "设备商", "晶圆", "fab", "foundry")
GLOBAL_SIGNALS = ("趋势", "总体", "整体", "主要", "概览", "全部", "所有", "汇总", "格局", "主题", "trend", "overall", "summary", "across", "main themes", "landscape", "in general")
LOCAL_SIGNALS = ("多少", "是什么", "什么状态", "具体", "how much", "what is", "status of")
SPECIFIC = r"\bN[0-9]+|\bHBM|\bEUV|JESD[0-9]+"
ENTITY_PATTERNS = ((r"\bN[0-9]+[A-Z]?\b", "ProcessNode"), (r"\bHBM[0-9]?[A-Z]?\b", "Standard"), (r"\bEUV\b|\bDUV\b", "Equipment"), (r"\bJESD[0-9]+\b", "Standard"))
COMPANIES = ("代工厂", "设备商", "公司", "Foundry", "TSMC", "ASML", "长鑫", "Fabless")
#: tier -> (model, build pages, extract relations, summarise)
TIER_BUDGET = {"A": ("strong", True, True, True), "B": ("small", False, True, True), "C": (None, False, False, False)}
#: action -> (roles, whether it needs confirmation)
ACTIONS = {
    "create_object": (("analyst", "strategy", "compliance"), False),
    "create_link": (("analyst", "strategy", "compliance"), False),
    "review": (("analyst", "strategy", "compliance"), False),
    "correct": (("analyst", "strategy", "compliance"), False),
    "merge": (("analyst", "strategy", "compliance"), False),
    "revise-capacity": (("analyst", "strategy", "compliance"), False),
    "advance-roadmap": (("analyst", "strategy", "compliance"), False),
    "promote": (("strategy", "compliance"), True),
    "mark": (("compliance",), True),
}
NEXT_STATUS = {"development": "risk", "risk": "HVM", "HVM": "EOL"}
SUMMARY_PREFIX, MASKED, ELLIPSIS = "[受控摘要] ", "•••• 受控字段", "…"
NO_CONTENT, ANSWER_PREFIX, ANSWER_JOIN = "（在你被授权访问的知识范围内未找到可接地的内容。）", "基于授权知识作答：", "；"
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "host.docker.internal", "vllm", "ollama")
WEAK_SECRETS = ("change-me", "change-me-dev-secret", "secret", "password", "neo4j")
DROP_BELOW, KEEP_FROM, UNSUPPORTED_MOST, FACT_CONFIDENCE = 0.60, 0.85, 0.55, 0.78
BM25_K1, BM25_B, RRF_K, RECALL, RERANK, COMMUNITIES = 1.5, 0.75, 60, 30, 8, 5
