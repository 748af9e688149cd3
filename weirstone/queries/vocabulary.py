"""Vocabularies the registered queries pass to the operators; any others can be passed instead."""

DEPARTMENTS = ["生态环境", "水利", "发改", "住建", "自然资源", "农业农村", "市场监管", "其他"]
REGIONS = {"全国(部委)": "全国", "部委": "全国", "其他省市": "其他"}
CORE = ["生态流量", "黑臭水体", "微塑料", "蓝藻", "水权", "底泥", "河长", "microplastic", "nutrient", "sediment"]
SUPPORT = ["总磷", "总氮", "氨氮", "溶解氧", "排污口", "水库", "湿地", "reservoir", "wetland", "turbidity"]
TOPICS = {
    "pollution": (["排污口", "黑臭水体", "微塑料", "抗生素", "microplastic", "antibiotic"], ["总磷", "总氮", "氨氮", "化学需氧量", "turbidity"]),
    "ecology": (["生态流量", "鱼类", "水生植被", "蓝藻", "fish passage", "benthic"], ["底栖", "浮游", "沉水植物", "生物", "macroinvertebrate"]),
    "management": (["河长", "水权", "跨界补偿", "应急演练", "allocation"], ["考核", "台账", "会商", "责任", "managers"]),
    "sediment": (["底泥", "沉积", "sediment"], ["厚度", "表层", "cores", "bottom water"]),
}
LABELS = {k: core + weak for k, (core, weak) in TOPICS.items()}
CLASSES = [("技术规范|Part [0-9]+", "standard"), ("通知|意见|函|批复|公告|实施方案", "policy"), ("月报|公报|Review", "report"), ("综述|Patterns|Evidence|Lessons|Assessment", "research")]
CLASS_RULES = {"title": CLASSES}
PLACES = {"河": ["江", "河", "溪"], "湖": ["湖", "湾"], "库": ["水库"], "湿地": ["湿地"], "en": ["River", "Lake", "Creek", "Wetland"]}
STATUS = [("废止|失效", "已废止"), ("修订|修正", "已修订")]
DOC_NO = [r"[一-鿿]{1,6}环发〔[0-9]{4}〕[0-9]+号", r"(?:ZLB|XT|DBQ)(?:/T)? [0-9]+(?:\.[0-9]+)?-[0-9]{4}", r"Part [0-9]+", r"第[0-9]+部分"]
ERROR_MARKS = ["页面不存在", "已经搬家或被移除", "服务器开小差", "no longer exists", "404"]
RISK_MARKS = ["滑块校验", "图形验证", "not a robot"]
ENTITIES = {"pollutant": ["总磷", "总氮", "氨氮", "石油类", "悬浮物", "化学需氧量", "叶绿素a", "高锰酸盐指数"], "group": ["底栖动物", "浮游动物", "沉水植物", "挺水植物", "着生藻类", "洄游鱼类"], "measure": ["河长履职", "生态浮岛", "水权交易", "鱼类增殖放流", "生态流量", "底泥清淤"]}
QUESTION = ["总磷", "浓度", "sediment", "wetland"]
AS_OF = "2025-06-30"

# Rules of the labels, for the test tables.
DASHED_CODE = r"(?:ZLB|XT|DBQ|GB|HJ|SL)(?:/T)? ?[0-9]+(?:\.[0-9]+)?[-—–－][0-9]{4}"
CODE_PREFIX = "ZLB/T|ZLB|XT/T|XT|DBQ/T|DBQ|GB/T|GB|HJ|SL"
NEWS = "一线观察|基层经验谈|三问三答|案例与启示|阶段进展综述|从试点到推广"
NEWS_ENDINGS = "的通知|的函|的意见|发布|全文"
KG_NOISE = "(?i)^(Biology|Chemistry|Ecology|Hydrology|Geology|Engineering)$"
PATCHES = {"底泥清淤": "底泥清淤专题正文", "水权交易": "水权交易专题正文", "黑臭水体": "黑臭水体专题正文"}
TOPIC_TERMS = {
    "pollution": (["黑臭水体", "抗生素", "排污口"], ["microplastic", "heavy metal"], ["总磷", "总氮", "氨氮"], ["turbidity"]),
    "ecology": (["生态流量", "鱼类增殖", "水生植被"], ["fish passage", "benthic"], ["底栖", "浮游"], ["phytoplankton"]),
    "management": (["河长履职", "水权交易", "跨界补偿"], ["allocation"], ["考核", "台账"], ["managers"]),
    "sediment": (["底泥清淤", "沉积风险"], ["sediment"], ["沉积物厚度"], ["cores"]),
}
OVERRIDES = {"跨界补偿协议": ["management", "pollution"], "跨界补偿": ["management"], "水权交易试行": ["management"]}
LEVELS = ["技术规范", "月报"]
LEVEL_RULES = [("技术规范", "技术规范|Part [0-9]+"), ("规范性文件", "〔[0-9]{4}〕[0-9]+号|通知|实施方案"), ("公报报告", "公报|月报"), ("技术导则", "指南|导则")]
ACADEMIC_URL = "doi\\.|openalex|europepmc"
ACADEMIC_SOURCES = ["journal", "university", "学报", "研究院", "institute", "observatory"]
DEPARTMENT_TERMS = {"水利": ["水利", "水文", "河长"], "生态环境": ["生态环境", "污染"], "住建": ["管网", "污水"], "农业农村": ["农田", "养殖"]}
DEPARTMENT_HOSTS = [("水利", "water|slt"), ("生态环境", "eco|env|mee")]
REGION_RULES = [("河网", ["江", "溪"], "creek"), ("湖区", ["湖", "湾"], "lake")]
KCLASSES = [("standard", ["技术规范"], ["技术规范"]), ("policy", ["规范性文件"], ["通知", "批复"]), ("report", ["公报报告"], ["公报", "月报"]), ("case", [], ["案例", "试点"]), ("tech", [], ["监测", "模型"])]
CONTENT_RULES = {"expert": ["专家", "团队"], "body": "研究院|实验室|中心", "borrow": ["试点", "案例"], "noise": "会议|座谈", "guides": ["技术导则"], "report": "公报|月报", "reports": ["公报报告"], "policy": ["规范性文件", "技术规范"]}
REJECTED = ["medical", "finance"]
TIERS = {"top": ["water", "river"], "core": ["学报", "湖泊", "环境"]}
AUTHORITIES = [("-gov\\.", 1.0, "official"), ("-wx\\.", 0.5, "account"), ("doi\\.", 0.7, "publisher")]
LEVEL_BASE = {"技术规范": 7.0, "规范性文件": 6.5, "公报报告": 6.0}
REGION_BONUS = {"河网": 0.6, "湖区": 0.4}
ISSUERS = "生态环境厅|水利厅"
TAG_STOP = ["进行", "以及", "或者"]
ORIGINS = {"蓝藻": "http://origin-a.example/algae", "清淤": "http://origin-b.example/dredge", "水权": "http://origin-c.example/rights"}
ACADEMIC_CLASSES = [("standard", r"技术规范|技术指南|国家标准|part [0-9]+"), ("basin_eng", "basin|river|lake|流域|湖|河|watershed"), ("management", "management|governance|管理|policy|补偿|allocation"), ("tech", "technolog|技术|monitor|监测|wetland|湿地|修复|model|模型"), ("intl_region", "international|transboundary|跨国")]
PLACES_ABROAD = r"(?i)china|中国|中华|中文"
MUST_FETCH = r"^https?://[^/]+/?$|/(?:index|list|default)[^/]*$"
