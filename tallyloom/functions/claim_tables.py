"""Tables of the claim extraction: what to strip, units, quantities, cues. All text is lower-case when they apply.

All of these are fixed values of the method; there is no logic here.
"""

from __future__ import annotations

# Windows in tokens, and sizes in characters.
PAIR_WINDOW = 12
EXCLUSION_WINDOW = 8
UNIT_WINDOW = 2
BLOCK_CHARS = 1500
SNIPPET_CHARS = 70

# Fixed values: (pattern, replacement) before lower-casing, in order.
STRIP_RAW = [
    (r"\S{120,}", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?:https?://|www\.)\S+", " "),
    (r"\S+@\S+\.\S+", " "),
    (r"(?i)</?[a-z][^>]{0,300}>", " "),
]
# Fixed values: (pattern, replacement) after lower-casing, in order.
STRIP_LOWER = [
    (r"(?s)share your feedback on copilot coding agent.*?survey\.?", " "),
    (r"link to devin run:.*?(?:\n|$)", " "),
    (r"co-authored-by:.*?(?:\n|$)", " "),
    (r"\b\d{4}-\d{2}-\d{2}(?:t[\d:.]+z?)?\b", " "),
    (r"\bv?\d+\.\d+\.\d+(?:[-+.][\w.]+)*\b", " "),
    (r"\b[0-9a-f]{7,40}\b", " "),
    (r"([　-ヿ㐀-鿿＀-￯])(?=[\d(~\-+])", "$1 "),
    (r"(?<=[\d)%xs])(?=[　-ヿ㐀-鿿＀-￯])", " "),
    (r"[、。：，（）「」【】]", " "),
    (r"(?<=\d)\s*(?:ナノ秒|纳秒)", "ns"),
    (r"(?<=\d)\s*(?:マイクロ秒|微秒)", "us"),
    (r"(?<=\d)\s*(?:ミリ秒|毫秒)", "ms"),
    (r"(?<=\d)\s*秒", "s"),
    (r"(?<=\d)\s*(?:分間|分钟|分)", "min"),
    (r"(?<=\d)\s*倍", "x "),
    (r"(?<=\d)\+(?=\s|$)", ""),
    (r"(?<=\d)\s*(?:nanoseconds?|nanosecs?|nsecs?)\b", "ns"),
    (r"(?<=\d)n(?=\s*±)", "ns"),
    (r"(?<=\d)\s*(?:microseconds?|microsecs?|usecs?|µs|μs)\b", "us"),
    (r"(?<=\d)\s*(?:milliseconds?|millisecs?|msecs?|millis)\b", "ms"),
    (r"(?<=\d)\s*(?:seconds?|secs?)\b", "s"),
    (r"(?<=\d)\s*(?:minutes?|mins?)\b", "min"),
    (r"(?<=\d)\s*(?:hours?|hrs?)\b", "hr"),
    (r"(?<=\d)\s*(?:kilobytes?|kib|kbytes?)\b", "kb"),
    (r"(?<=\d)\s*(?:megabytes?|mib|mbytes?)\b", "mb"),
    (r"(?<=\d)\s*(?:gigabytes?|gib|gbytes?)\b", "gb"),
    (r"(?<=\d)\s*(?:terabytes?|tib)\b", "tb"),
    (r"(?<=\d)\s*bytes?\b", "b"),
    (r"×", "x"),
    (r"→|⟶|⇒|=>|->|-->", " -> "),
    (r"[–—]", "-"),
    (r"≈|~", "~"),
]

# Numbers, units and comparatives that the patterns below are made of.
NUM = r"(?:~\s?)?\d(?:[\d,]*\d)?(?:\.\d+)?"
TIME = r"(?:ns|us|ms|s|min|hr)"
BYTES = r"(?:b|kb|mb|gb|tb)"
RATE = r"(?:ops?/s(?:ec)?|op/s|req(?:uests?)?/s(?:ec)?|qps|rps|tps|items?/s(?:ec)?|tokens?/s(?:ec)?|msgs?/s(?:ec)?|messages?/s(?:ec)?|events?/s(?:ec)?|it/s|iters?/s(?:ec)?|rows?/s(?:ec)?|records?/s(?:ec)?|(?:mb|gb|kb)/s|mbps|gbps|kbps|fps|/s(?:ec)?)"
ENERGY = r"(?:j|kj|mj|kwh|wh|mah|watts?|joules?)"
MONEY = r"(?:usd|eur|gbp|dollars?|cents?)"
COMPARATIVE = (
    r"(?:\b(?:faster|slower|quicker|speed[- ]?ups?|improv(?:e|es|ed|ement|ements)|reduc(?:e|es|ed|tion|tions)|decreas(?:e|es|ed)|increas(?:e|es|ed)|"
    r"fewer|less|more|smaller|larger|lower|higher|shorter|longer|sav(?:e|es|ed|ing|ings)|cuts?|dropp?(?:ed|s)?|shr[ai]nk|shrunk|down|up|gain|gains|regress(?:ion|ed)|slowdown|overhead|boost(?:ed)?)\b"
    r"|(?:削減|減少|短縮|改善|向上|高速化|低下|増加|提升|降低|减少|提高|加速|优化|缩短|下降|增加|改进))"
)
SPEED = r"(?:\b(?:faster|slower|quicker|speed[- ]?ups?|speedup)\b|(?:高速化|加速|短縮|缩短))"
GAP = r"\s*(?:\S{1,40}\s+){0,5}[*_`(\[]{0,3}"

# Kinds of quantities.
QUANTITIES = {
    "time": rf"(?:\b(?!(?:19|20)\d{{2}}s\b){NUM}\s?{TIME}\b|\({TIME}\)\s*[:=]?\s*{NUM}\b)",
    "bytes": rf"\b{NUM}\s?{BYTES}\b",
    "rate": rf"\b{NUM}\s?{RATE}\b",
    "energy": rf"\b{NUM}\s?{ENERGY}\b",
    "currency": rf"(?:[$€£]\s?\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?\b|[$€£]\s?\d+\.\d{{2}}\b|[$€£]\s?\d{{2,}}\b|\b{NUM}\s?{MONEY}\b)",
    "mult": rf"(?:\b{NUM}\s?x\b{GAP}{COMPARATIVE}|{COMPARATIVE}{GAP}{NUM}\s?x\b|\b{NUM}\s?(?:x|times)\s+(?:as\s+)?{SPEED}|\b{NUM}\s?times\s+(?:fewer|less|more|smaller|larger))",
    "pct": rf"(?:(?<![\w.])[-+]\s?{NUM}\s?%|\b{NUM}\s?(?:%|percent){GAP}{COMPARATIVE}|{COMPARATIVE}{GAP}{NUM}\s?(?:%|percent)|\bby\s+(?:~|about|approximately|roughly|around|over|up to|nearly)?\s*{NUM}\s?(?:%|percent))",
    "from_to": rf"(?:\bfrom\s+[*_`(]{{0,3}}{NUM}\S{{0,12}}\s+(?:\S{{1,40}}\s+){{0,3}}?(?:to|->)\s+[*_`(]{{0,3}}{NUM}|\b{NUM}\S{{0,12}}\s+(?:\S{{1,40}}\s+){{0,4}}?->\s+[*_`(]{{0,3}}{NUM})",
    "before_after": rf"\b(?:before|after|old|new|baseline|original|optimi[sz]ed|prev(?:ious)?|current)\b\s*(?:[:=|]|->)\s*\**{NUM}\b",
}
UNIT_KINDS = ["bytes", "currency", "energy", "rate", "time"]
_COMPARED = ["before_after", "from_to", "mult", "pct"]

# Wording that makes a statement hypothetical, and headings that make their block so.
HYPOTHETICAL = (
    r"\b(?:should|would|could|might|may|shall|will|won't|wouldn't|todo|fixme|tbd|plan(?:s|ned|ning)?\s+to|need(?:s|ed)?\s+to\s+(?:be\s+)?(?:measure|benchmark|profile|verif|test|confirm)\w*|"
    r"expect(?:s|ed)?(?:\s+to)?|estimat(?:e|es|ed|ion)|theoretical(?:ly)?|potential(?:ly)?|hypothetical(?:ly)?|in\s+theory|ideally|hopefully|aim(?:s|ed)?\s+to|intend(?:s|ed)?\s+to|goal|target(?:s|ed|ing)?\s+(?:a|an|to)|"
    r"not\s+(?:yet\s+)?(?:measured|benchmarked|profiled|tested|verified)|untested|unmeasured|no\s+benchmarks?|coverage|codecov)\b"
)
PROSPECTIVE = r"(?m)^[\s#*>\-+\d.]{0,8}(?:expected|estimated|projected|anticipated|theoretical|potential|planned|hypothes(?:is|ised|ized))\b[^\n]{0,70}$"
BLOCK_BREAK = r"\n\s*\n|\n[ \t]*#"

# Dimensions, their cues, and the kinds of quantities that may be claims about them.
CUES = {
    "D1": (
        r"(?:\b(?:latenc(?:y|ies)|run[- ]?time|execution[- ]time|exec[- ]time|elapsed(?:[- ]time)?|response[- ]time|wall[- ]?clock|wall[- ]?time|startup(?:[- ]time)?|start-up|boot[- ]time|cold[- ]start|load(?:ing)?[- ]time|render(?:ing)?[- ]time|processing[- ]time|"
        r"request[- ]time|query[- ]time|frame[- ]time|duration|time[- ]to[- ](?:first[- ]byte|interactive|first[- ]paint)|ttfb|tti|lcp|fcp|p(?:50|75|90|95|99|999)|percentile|tail[- ]latency|speed[- ]?ups?|faster|slower|quicker|took|takes|taking|timing|time)\b"
        r"|実行時間|処理時間|所要時間|応答時間|レイテンシ|高速化|耗时|执行时间|运行时间|响应时间|延迟|时间)"
    ),
    "D2": (
        r"(?:\b(?:throughput|ops?/s(?:ec)?|req(?:uests?)?/s(?:ec)?|requests?\s+per\s+second|queries\s+per\s+second|transactions?\s+per\s+second|qps|rps|tps|items?/s(?:ec)?|tokens?/s(?:ec)?|msgs?/s(?:ec)?|events?/s(?:ec)?|it/s|iters?/s(?:ec)?|"
        r"rows?/s(?:ec)?|records?/s(?:ec)?|(?:mb|gb|kb)/s|mbps|gbps|fps|frames\s+per\s+second|per\s+second|/sec)\b|スループット|吞吐量|吞吐)"
    ),
    "D3": (
        r"(?:\b(?:(?<!in-)(?<!in )memory|mem|heap|rss|resident[- ]set|footprint|alloc(?:ation|ations|ated|ating|s)?|garbage[- ]collect(?:ion|or|ed)?|gc(?:[- ](?:pause|pressure|time|cycles?|overhead))?|memory[- ]leaks?|leak(?:s|ing|ed)?|oom|out[- ]of[- ]memory|swap|"
        r"page[- ]faults?|peak[- ](?:memory|rss)|retained|objects?[- ]created|bytes[- ]allocated|arena|pool[- ]size)\b|メモリ|ヒープ|内存|堆内存)"
    ),
    "D4": (
        r"(?:\b(?:cpu(?:[- ](?:usage|time|load|utili[sz]ation|cycles|cores?|bound))?|utili[sz]ation|cpu[- ]cycles|clock[- ]cycles|cycles[- ](?:saved|reduced)|instructions?[- ](?:count|retired|executed)|instruction[- ]count|ipc|flops|function[- ]calls|method[- ]calls|"
        r"call[- ]count|ncalls|invocations?|branch[- ]mispredict\w*|branch[- ]misses|compute[- ]time|cores?[- ]used)\b|呼び出し回数|関数呼び出し|cpu使用率|cpu占用|调用次数)"
    ),
    "D5": (
        r"\b(?:n\+1|round[- ]?trips?|query[- ]count|number[- ]of[- ]queries|fewer[- ]queries|(?:db|database|sql)[- ](?:calls?|queries|query|hits?|round[- ]?trips?|operations?)|queries[- ](?:reduced|from|to|per[- ]request|per[- ]page)|api[- ](?:calls?|requests?)|"
        r"http[- ](?:calls?|requests?)|network[- ](?:calls?|requests?|round[- ]?trips?|traffic|transfer|usage|bandwidth|i/o)|requests?[- ](?:count|made|sent|per[- ]page)|payload(?:[- ]size)?|bytes[- ](?:transferred|sent|received|read|written)|transfer(?:red)?[- ]size|"
        r"response[- ]size|request[- ]size|bandwidth|cache[- ]hits?|hit[- ]rate|hit[- ]ratio|miss[- ]rate|cache[- ]miss(?:es)?|disk[- ](?:reads?|writes?|io|i/o)|i/o|io[- ]ops|iops|syscalls?|file[- ](?:reads?|writes?|operations)|(?:\d\s?b|byte|small|tiny)[- ]writes)\b"
    ),
    "D6": (
        r"\b(?:bundle(?:[- ]size)?s?|binary[- ]size|executable[- ]size|image[- ]size|artifact[- ]size|package[- ]size|wasm[- ]size|gzip(?:ped)?|brotli|minified|chunk[- ]size|dist[- ]size|apk|ipa|jar[- ]size|wheel[- ]size|install[- ]size|download[- ]size|"
        r"file[- ]size|code[- ]size|build[- ]size|output[- ]size|tree[- ]?shak\w+|dead[- ]code|size[- ]of[- ]the[- ](?:bundle|binary|image|package))\b"
    ),
    "D7": (
        r"(?:ビルド時間|编译时间|构建时间|\b(?:build(?:ing)?[- ]times?|build[- ]duration|builds?[- ](?:take|takes|took|taking|run|complete)|compil(?:e|ation)[- ]times?|compil(?:e|es|ing|ation)[- ](?:takes?|took)|rebuild(?:s|ing)?(?:[- ]time)?|incremental[- ]build|"
        r"ci[- ](?:time|duration|runs?|pipelines?|jobs?)|pipeline[- ](?:time|duration)|run[- ]duration|test[- ](?:suite|run|execution)?[- ]?(?:time|duration)|tests?[- ](?:take|takes|took|run[- ]in|complete[- ]in|finish[- ]in)|typecheck(?:ing)?[- ]time|tsc[- ]time|"
        r"lint(?:ing)?[- ]time|bundling[- ]time|webpack[- ]build|vite[- ]build|link(?:ing)?[- ]time|hot[- ]reload|hmr|docker[- ]build)\b)"
    ),
    "D8": r"\b(?:joules?|kwh|watts?|energy|power[- ](?:consumption|draw|usage)|battery|carbon|co2|spend(?:ing)?|billing|bill|price|pricing|token[- ]cost|api[- ]cost|cloud[- ]cost|compute[- ]cost|infra(?:structure)?[- ]cost|(?<!at the )(?<!the )costs?(?! of))\b",
    "D9": (
        r"\b(?:concurren(?:cy|t)(?![- ](?:safe|safety|issues?|bugs?|model|primitives?))|parallelism|under[- ]load|load[- ]test(?:ing|s)?|stress[- ]test|contention|lock(?:s|ing)?[- ](?:wait|contention)|scalability|scal(?:es|ing)[- ](?:to|up|linearly|with)|thread[- ]pool|"
        r"worker[- ]pool|connection[- ]pool(?:ing)?|backpressure|queue[- ](?:depth|length)|saturat(?:ion|ed)|simultaneous)\b"
    ),
    "D0": r"\b(?:performance|perf|efficiency|efficient|overhead|slowness|bottlenecks?|responsiveness|snappier|sluggish|optimi[sz]ation gains?|speed)\b",
}
KINDS = {
    "D1": ["time", *_COMPARED],
    "D2": ["rate", *_COMPARED],
    "D3": ["bytes", *_COMPARED],
    "D4": ["time", *_COMPARED],
    "D5": ["bytes", "rate", *_COMPARED],
    "D6": ["bytes", *_COMPARED],
    "D7": ["time", *_COMPARED],
    "D8": ["energy", "currency", *_COMPARED],
    "D9": _COMPARED,
    "D0": _COMPARED,
}
# Dimensions whose phrases are hidden from another's cues; whose cues nearby silence it; which is the fallback.
HIDDEN_FROM = {"D1": ["D7"], "D5": ["D2", "D1"]}
SILENCED_BY = {"D1": ["D7"]}
FALLBACK = "D0"
# Constructions that name their dimension: dimension, pattern, kinds of which one must be near, silencing dimensions.
SELF_SUFFICIENT = [
    ("D1", rf"\b{NUM}\s?(?:x|times)\s+(?:as\s+)?{SPEED}", [], ["D7"]),
    ("D1", rf"\b{NUM}\s?(?:%|percent)\s*{SPEED}", [], ["D7"]),
    ("D1", rf"{SPEED}\W*(?:of|by)?\W*{NUM}\s?(?:x|%|percent)\b", [], ["D7"]),
    ("D1", rf"\b{NUM}\s?{TIME}\b", _COMPARED, ["D7"]),
    ("D1", rf"\|\s*\**{NUM}\s?{TIME}\**\s*\|", [], ["D7"]),
    ("D3", rf"(?:allocated|alloc ratio|gen ?0|memory|heap)[^\n]{{0,400}}\n(?:[^\n]*\n){{0,40}}?[^\n]*\|\s*\**{NUM}\s?{BYTES}\**\s*\|", [], []),
    ("D2", rf"\b{NUM}\s?{RATE}\b", [], []),
    ("D2", rf"\b{NUM}\s?(?:k|m|million|thousand|billion)?\s+(?:\S{{1,40}}\s+){{0,2}}per\s+second\b", [], []),
    ("D9", rf"\b{NUM}\s?(?:concurrent|workers?|threads?|connections?|users|clients|goroutines?|cores?|parallel|simultaneous)\b", [], []),
]

# Dimension and the pattern of phrases that speak of it; narrow phrases that are credited before the others.
EXPECTED = [
    ("D1", r"latency|execution time|runtime|run time|response time|load time|instruction latency|faster|speed ?up"),
    ("D2", r"throughput|ilp|instruction[- ]level parallelism|instruction throughput|requests? per second|greater throughput"),
    ("D3", r"memory|heap|footprint|allocation|\bgc\b|garbage"),
    ("D4", r"cpu|cycles|instruction count|instruction-level efficiency|execution count|operations? (?:are )?executed|call count|method calls|branch (?:instruction|mispredict)|context switch|thread count|resource utili[sz]ation|utilization|cpi|cache miss|cache line|cache efficiency|cache hit|store forwarding|mob loads|page miss|replays"),
    ("D5", r"\bi/o\b|io |network|bandwidth|payload|round ?trip|\bqueries\b|cache hit rate|data transfer"),
    ("D6", r"build size|binary size|bundle|artifact size|code size|smaller build"),
    ("D7", r"build time|compile time|compilation time|rebuild|\bci\b"),
    ("D8", r"energy|power|joule|watt|carbon|\bcost\b"),
    ("D9", r"concurren|parallelism|scalab|thread pool|contention|workers|under load"),
]
EXPECTED_FIRST = [
    (r"faster build times?|build times?", "D7"),
    (r"cache hit rate", "D5"),
    (r"memory utili[sz]ation", "D3"),
    (r"instruction[- ]level parallelism|\bilp\b", "D2"),
    (r"i-cache|cache miss|cache line|cache efficiency", "D4"),
]
