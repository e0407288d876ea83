"""The rule catalogue: patterns, packs and advice, as data."""

from __future__ import annotations

from dataclasses import dataclass

from reviewloom.functions.binding import quoted
from reviewloom.functions.dialect import (
    ANY,
    IN_LINE,
    INLINE_SPACE_CLASS,
    LINE_ENDS,
    LINE_START,
    SPACE,
    WORD,
    to_java,
)


@dataclass(frozen=True)
class Pattern:
    regex: str  # ECMAScript form
    needs: tuple[str, ...] = ()  # one of these must be in the text
    ignore_case: bool = False
    starts: str = ""  # every match starts with one of these characters, in either case
    # The same matches found in linear time: Java, with what is skipped in group 1 and the match in group 2,
    # or in 3 and 4.
    linear: str = ""
    # Or the part of the text (SQL) that ``cut_java`` finds the same matches in, in linear time.
    cut: str = ""
    cut_regex: str = ""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_ord: int
    kind: str  # security | performance
    type: str
    level: str  # critical | high | medium | low
    pattern: Pattern
    note: str
    advice: str

    @property
    def java(self) -> str:
        """The form that is run."""
        p = self.pattern
        return p.linear or to_java(p.cut_regex or p.regex, p.ignore_case, p.starts)

    def text(self, text: str) -> str:
        """The part of a text (SQL) that the form is run on."""
        return self.pattern.cut.replace("{text}", text) if self.pattern.cut else text

    @property
    def marked(self) -> tuple[str, str]:
        """What goes before and after a mark that is put at the start of a match."""
        if not self.pattern.linear:
            return "", "$0"
        return ("$1$3", "$2$4") if self.pattern.linear is _DOM_LOOP else ("$1", "$2")


# Some patterns take quadratic or cubic time in Java: each start that leads nowhere reads on to the end of its
# line or of the text.  The forms below look at the first start only where all later ones must fail with it.
_LINE = f"(?:{LINE_START}|\\G)"
_WORD_END = f"(?<={WORD})(?!{WORD})"


def _first(start: str, skipped: str) -> str:
    """Skip to the first place where ``start`` matches, for good."""
    return f"((?>{skipped}*?(?={start})))"


# A statement: from the first ``${`` of a line; its end is the last call on the line.
_TEMPLATE_SQL = (
    _LINE + _first(r"\$\{", IN_LINE) + rf"(\$\{{[^}}{LINE_ENDS}]*+\}}{IN_LINE}*(?:query|execute|exec){SPACE}*\()"
)
# A loop: from the first one of a line.  The brace is the last of the line, or the last with a name before the next
# brace.  A loop whose parenthesis is on a later line is the last thing on its own.
_NAME = f"(?<!{WORD})(?:document|DOM|innerHTML){_WORD_END}"
_BODY = rf"(?:(?>{IN_LINE}*\{{)[^}}]*{_NAME}|{IN_LINE}*\{{[^{{}}{LINE_ENDS}]*{_NAME})"
_LOOP = rf"(?:for|while)[{INLINE_SPACE_CLASS}]*\("
_LOOP_OVER = rf"(?:for|while)[{INLINE_SPACE_CLASS}]*[{LINE_ENDS}]"
_DOM_LOOP = (
    _LINE + rf"(?:{_first(_LOOP, IN_LINE)}({_LOOP}{_BODY})|{_first(_LOOP_OVER, IN_LINE)}({_LOOP_OVER}{SPACE}*\({_BODY}))"
)
# A timer: from the first one before a comma.
_TIMER = rf"setInterval{SPACE}*\([^,]"
_FAST_TIMER = (
    rf"(?:^|(?<=,)|\G){_first(_TIMER, '[^,]')}(setInterval{SPACE}*\([^,]+,{SPACE}*(?:[0-9]|[1-9][0-9]){SPACE}*\))"
)
# What may end anywhere later: from the first start; if that has no end, no later one has.
_TRY = rf"try{SPACE}*\{{"
_EMPTY_CATCH_TRY = (
    rf"\G{_first(_TRY, ANY)}({_TRY}{ANY}*?\}}{SPACE}*catch{SPACE}*\({SPACE}*{WORD}*{SPACE}*\){SPACE}*\{{{SPACE}*\}})"
)
_EFFECT = rf"(?:useState|useEffect){SPACE}*\({SPACE}*\(\){SPACE}*=>{SPACE}*\{{"
_EFFECT_FETCH = rf"\G{_first(_EFFECT, ANY)}({_EFFECT}{ANY}*?fetch)"

# The patterns the rules look for.
PATTERNS = {
    "eval_call": Pattern(r"eval\s*\(", ("eval",)),
    "function_ctor": Pattern(r"new\s+Function\s*\(", ("Function",)),
    "inner_html": Pattern(r"innerHTML\s*=", ("innerHTML",)),
    "react_html": Pattern(r"dangerouslySetInnerHTML", ("dangerouslySetInnerHTML",)),
    "document_write": Pattern(r"document\.write\s*\(", ("document.write",)),
    "template_sql": Pattern(
        r"\$\{.*\}.*(?:query|execute|exec)\s*\(", ("${",), linear=_TEMPLATE_SQL
    ),
    "quoted_secret": Pattern(
        r"""(?:password|secret|api_key|apikey|token)\s*[:=]\s*['"][^'"]+['"]""",
        ignore_case=True,
        starts="past",
    ),
    "quoted_secret_short": Pattern(
        r"""(?:password|secret|api_key|token)\s*[:=]\s*['"][^'"]+['"]""",
        ignore_case=True,
        starts="past",
    ),
    "logged_secret": Pattern(
        r"""(?:console\.log|console\.debug|console\.warn)\s*\(\s*['"](?:password|token|secret)""",
        ignore_case=True,
        starts="c",
    ),
    "shell_string_any": Pattern(
        r"""(?:exec|spawn|execSync|spawnSync)\s*\(\s*['"`]""", ("exec", "spawn")
    ),
    "shell_string": Pattern(r"""(?:exec|spawn|execSync)\s*\(\s*['"`]""", ("exec", "spawn")),
    "shell_string_async": Pattern(r"""(?:exec|spawn)\s*\(\s*['"`]""", ("exec", "spawn")),
    "weak_random": Pattern(r"Math\.random\s*\(\)", ("Math.random",)),
    "spread_assign": Pattern(r"(?:Object\.assign|Spread)\s*\(\s*\{\s*\.\.\.", ("...",)),
    "atob_call": Pattern(r"atob\s*\(", ("atob",)),
    "dom_redirect": Pattern(
        r"(?:document\.write|window\.location\s*=)", ("document.write", "window.location")
    ),
    "string_timer": Pattern(
        r"""(?:setTimeout|setInterval)\s*\(\s*['"`]""", ("setTimeout", "setInterval")
    ),
    "exec_call": Pattern(r"exec\s*\(", ("exec",)),
    "dunder_import": Pattern(r"__import__\s*\(", ("__import__",)),
    "pickle_load": Pattern(r"pickle\.loads?\s*\(", ("pickle.load",)),
    "os_system": Pattern(r"os\.system\s*\(", ("os.system",)),
    "subprocess_string": Pattern(r"""subprocess\.call\s*\(\s*['"`]""", ("subprocess.call",)),
    "yaml_load": Pattern(
        r"yaml\.load\s*\((?!.*Loader)",
        ("yaml.load",),
        # What has a Loader after it on its line is left out at once.
        cut=f"regexp_replace({{text}}, {quoted(f'{LINE_START}{IN_LINE}*Loader')}, '#')",
        cut_regex=r"yaml\.load\s*\(",
    ),
    "sql_concat": Pattern(r"""SQL\s*\+\s*f?['"`]""", ("SQL",)),
    "runtime_exec": Pattern(
        r"Runtime\.getRuntime\(\)\.exec", ("Runtime.getRuntime().exec",)
    ),
    "object_stream": Pattern(r"ObjectInputStream", ("ObjectInputStream",)),
    "xml_parser": Pattern(
        r"XMLReader|SAXParser|DocumentBuilder", ("XMLReader", "SAXParser", "DocumentBuilder")
    ),
    "go_exec": Pattern(r"os\.Exec\s*\(", ("os.Exec",)),
    "go_html": Pattern(r"template\.HTML\s*\(", ("template.HTML",)),
    "unsafe_block": Pattern(r"unsafe\s*\{", ("unsafe",)),
    "delete_from": Pattern(
        r"(?:DELETE|DROP|TRUNCATE)\s+FROM", ignore_case=True, starts="dt"
    ),
    "await_chain": Pattern(
        r"(?:await|\.then\().*(?:await|\.then\().*(?:await|\.then\()", ("await", ".then(")
    ),
    "async_map": Pattern(r"\.map\s*\(\s*async", (".map",)),
    "json_clone": Pattern(r"JSON\.parse\s*\(\s*JSON\.stringify", ("JSON.stringify",)),
    "dom_loop": Pattern(
        r"(?:for|while)\s*\(.*\{[^}]*\b(?:document|DOM|innerHTML)\b",
        ("document", "DOM", "innerHTML"),
        linear=_DOM_LOOP,
    ),
    "fast_timer": Pattern(
        r"setInterval\s*\([^,]+,\s*(?:[0-9]|[1-9][0-9])\s*\)",
        ("setInterval",),
        linear=_FAST_TIMER,
    ),
    "new_regexp": Pattern(r"new\s+RegExp\s*\(", ("RegExp",)),
    "new_regexp_args": Pattern(
        r"new\s+RegExp\s*\([^)]+\)",
        ("RegExp",),
        # Nothing after the last parenthesis can be the beginning of a match.
        cut="left({text}, length({text}) - coalesce(nullif(locate(')', reverse({text})), 0) - 1, length({text})))",
        cut_regex=r"new\s+RegExp\s*\([^)]+\)",
    ),
    "empty_catch_try": Pattern(
        r"(?:try\s*\{[\s\S]*?\}\s*catch\s*\(\s*\w*\s*\)\s*\{\s*\})",
        ("catch",),
        linear=_EMPTY_CATCH_TRY,
    ),
    "effect_fetch": Pattern(
        r"(?:useState|useEffect)\s*\(\s*\(\)\s*=>\s*\{[\s\S]*?fetch",
        ("fetch",),
        linear=_EFFECT_FETCH,
    ),
    "async_foreach": Pattern(r"\.forEach\s*\(\s*async", (".forEach",)),
    "console_call": Pattern(r"console\.(log|warn|error|debug|info)\s*\(", ("console.",)),
    "var_decl": Pattern(r"(?:var\s+)", ("var",)),
    "range_len": Pattern(r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\(", ("range",)),
    "plus_quote": Pattern(r"""\+\s*=\s*['"]""", ("+",)),
    "star_import": Pattern(r"import\s+\*", ("import",)),
    "string_buffer": Pattern(r"new\s+StringBuffer\s*\(", ("StringBuffer",)),
    "equals_literal": Pattern(r"""\.equals\s*\(\s*['"]""", (".equals",)),
    "while_true": Pattern(r"while\s*\(\s*true\s*\)", ("while",)),
    "empty_catch": Pattern(r"catch\s*\(\s*\w*\s*\)\s*\{\s*\}", ("catch",)),
}

# What a finding of each pattern means and what to do about it.
ADVICE = {
    "eval_call": ("Text is run as code by eval", "Parse the data, or dispatch on known names"),
    "function_ctor": ("Code is compiled from text", "Pass a closure instead of source text"),
    "inner_html": ("Markup is assigned without escaping", "Assign textContent or clean the markup"),
    "react_html": ("Component skips markup escaping", "Clean the markup before it is rendered"),
    "document_write": ("Page is rewritten from text", "Build the nodes and append them"),
    "template_sql": ("Statement text is built from values", "Bind the values as parameters"),
    "quoted_secret": ("A credential is written in the source", "Load it from a vault or the environment"),
    "quoted_secret_short": ("A credential is written in the source", "Load it from a vault or the environment"),
    "logged_secret": ("A credential goes to the console", "Drop the statement or mask the value"),
    "shell_string_any": ("A command line is given as one string", "Give the program and its arguments apart"),
    "shell_string": ("A command line is given as one string", "Give the program and its arguments apart"),
    "shell_string_async": ("A command line is given as one string", "Give the program and its arguments apart"),
    "weak_random": ("Random numbers can be guessed", "Take them from the cryptographic generator"),
    "spread_assign": ("Foreign keys are merged into an object", "Check the keys before merging"),
    "atob_call": ("Encoded text is decoded unchecked", "Check what was decoded before use"),
    "dom_redirect": ("Page or address is set from script", "Check the value, use node methods"),
    "string_timer": ("Timer is given text to run", "Give the timer a function"),
    "exec_call": ("Text is run as a program", "Keep outside text away from exec"),
    "dunder_import": ("Module name is chosen at run time", "Import the modules by name"),
    "pickle_load": ("Unpickling can run code", "Use a data-only format"),
    "os_system": ("Command goes through the shell", "Run the program with a list of arguments"),
    "subprocess_string": ("Command goes through as one string", "Run the program with a list of arguments"),
    "yaml_load": ("Document is loaded without a safe loader", "Name the safe loader"),
    "sql_concat": ("Statement text is glued together", "Bind the values as parameters"),
    "runtime_exec": ("A system command is started", "Start it through a checked argument list"),
    "object_stream": ("Objects are read back unchecked", "Use a data-only format"),
    "xml_parser": ("Parser may follow outside entities", "Switch outside entities off"),
    "go_exec": ("A system command is started", "Give the program and its arguments apart"),
    "go_html": ("Template escaping is switched off", "Keep it for text you wrote yourself"),
    "unsafe_block": ("Memory checks are switched off", "Keep the block small and explain it"),
    "delete_from": ("Rows are removed in bulk", "Narrow the condition and try it as a select"),
    "await_chain": ("Calls wait for one another", "Start them together and wait once"),
    "async_map": ("Calls start without a limit", "Bound how many run at once"),
    "json_clone": ("Copy goes through text", "Use a structural copy"),
    "dom_loop": ("Page is touched in a loop", "Collect the changes and apply them once"),
    "fast_timer": ("Timer fires very often", "Tie the work to frames or slow it down"),
    "new_regexp": ("Expression is built at run time", "Keep expressions constant"),
    "new_regexp_args": ("Expression is built at run time", "Keep expressions constant"),
    "empty_catch_try": ("Failures vanish silently", "Record the failure or pass it on"),
    "effect_fetch": ("Request outlives its component", "Cancel it when the component goes"),
    "async_foreach": ("Loop does not wait for its calls", "Use a loop that waits"),
    "console_call": ("Console output was left in", "Use the logger"),
    "var_decl": ("Variable leaks out of its block", "Declare it with block scope"),
    "range_len": ("Loop counts instead of iterating", "Iterate the values"),
    "plus_quote": ("Text grows piece by piece", "Join the pieces once"),
    "star_import": ("Everything is imported", "Import what is used"),
    "string_buffer": ("Buffer locks on each call", "Use the builder without locks"),
    "equals_literal": ("Literal is compared as argument", "Check for null on the other side"),
    "while_true": ("Loop has no end of its own", "Add a bound or a wait"),
    "empty_catch": ("Failures vanish silently", "Record the failure or pass it on"),
}

# The packs, in rule order, as (pattern, type, level).
_PACKS = {
    ("PS", "security"): [
        ("eval_call", "Code Injection", "critical"),
        ("function_ctor", "Code Injection", "critical"),
        ("inner_html", "XSS", "high"),
        ("react_html", "XSS", "high"),
        ("document_write", "XSS", "medium"),
        ("template_sql", "SQL Injection", "critical"),
        ("quoted_secret", "Hardcoded Secret", "critical"),
        ("logged_secret", "Credential Leak", "high"),
        ("shell_string_any", "Command Injection", "high"),
        ("weak_random", "Weak Randomness", "medium"),
        ("spread_assign", "Prototype Pollution Risk", "medium"),
        ("atob_call", "Unsafe Deserialization", "low"),
    ],
    ("PP", "performance"): [
        ("await_chain", "Waterfall Requests", "high"),
        ("async_map", "N+1 Pattern", "high"),
        ("json_clone", "Deep Clone Inefficiency", "medium"),
        ("dom_loop", "DOM Thrashing", "high"),
        ("fast_timer", "High-Frequency Timer", "medium"),
        ("new_regexp", "Dynamic Regex", "low"),
        ("empty_catch_try", "Silent Error Swallowing", "medium"),
        ("effect_fetch", "Uncontrolled Fetch", "medium"),
    ],
    ("RS", "security"): [
        ("eval_call", "Code Injection", "critical"),
        ("function_ctor", "Code Injection", "critical"),
        ("inner_html", "XSS", "high"),
        ("react_html", "XSS", "high"),
        ("template_sql", "SQL Injection", "critical"),
        ("quoted_secret", "Hardcoded Secret", "critical"),
        ("shell_string", "Command Injection", "high"),
        ("weak_random", "Weak Randomness", "medium"),
    ],
    ("CS", "security"): [
        ("eval_call", "Code Injection", "critical"),
        ("function_ctor", "Code Injection", "critical"),
        ("inner_html", "XSS", "high"),
        ("react_html", "XSS", "high"),
        ("template_sql", "SQL Injection", "critical"),
        ("quoted_secret", "Hardcoded Secret", "critical"),
        ("shell_string", "Command Injection", "high"),
        ("weak_random", "Weak Randomness", "medium"),
        ("dom_redirect", "DOM Manipulation", "medium"),
        ("string_timer", "Code Injection", "high"),
        ("exec_call", "Code Injection", "critical"),
        ("dunder_import", "Dynamic Import", "high"),
        ("pickle_load", "Unsafe Deserialization", "critical"),
        ("os_system", "Command Injection", "high"),
        ("subprocess_string", "Command Injection", "high"),
        ("yaml_load", "Unsafe YAML", "high"),
        ("sql_concat", "SQL Injection", "critical"),
        ("runtime_exec", "Command Injection", "critical"),
        ("object_stream", "Unsafe Deserialization", "critical"),
        ("xml_parser", "XXE", "high"),
        ("go_exec", "Command Injection", "high"),
        ("go_html", "XSS", "high"),
        ("unsafe_block", "Unsafe Block", "medium"),
        ("delete_from", "Destructive SQL", "high"),
    ],
    ("CP", "performance"): [
        ("async_foreach", "Async Anti-pattern", "high"),
        ("new_regexp_args", "Dynamic Regex", "medium"),
        ("json_clone", "Slow Deep Clone", "medium"),
        ("console_call", "Console Statement", "low"),
        ("var_decl", "Var Usage", "low"),
        ("range_len", "Non-Pythonic Loop", "low"),
        ("plus_quote", "String Concatenation", "medium"),
        ("star_import", "Wildcard Import", "low"),
        ("string_buffer", "StringBuffer Usage", "low"),
        ("equals_literal", "String Comparison", "low"),
        ("while_true", "Infinite Loop Risk", "medium"),
        ("empty_catch", "Swallowed Error", "medium"),
    ],
    ("DS", "security"): [
        ("eval_call", "Code Injection", "critical"),
        ("inner_html", "XSS", "high"),
        ("react_html", "XSS", "high"),
        ("template_sql", "SQL Injection", "critical"),
        ("quoted_secret_short", "Hardcoded Secret", "critical"),
        ("shell_string_async", "Command Injection", "high"),
    ],
    ("DP", "performance"): [
        ("await_chain", "Waterfall Requests", "high"),
        ("async_map", "N+1 Pattern", "high"),
        ("json_clone", "Deep Clone Inefficiency", "medium"),
        ("fast_timer", "High-Frequency Timer", "medium"),
        ("empty_catch_try", "Silent Error Swallowing", "medium"),
    ],
}


def _build(prefix: str, kind: str) -> list[Rule]:
    return [
        Rule(f"{prefix}{i:02d}", i, kind, type_, level, PATTERNS[name], *ADVICE[name])
        for i, (name, type_, level) in enumerate(_PACKS[(prefix, kind)], start=1)
    ]


PR_SECURITY = _build("PS", "security")
PR_PERFORMANCE = _build("PP", "performance")
REPO_SECURITY = _build("RS", "security")
CODE_SECURITY = _build("CS", "security")
CODE_PERFORMANCE = _build("CP", "performance")
DIFF_SECURITY = _build("DS", "security")
DIFF_PERFORMANCE = _build("DP", "performance")

ALL_PACKS = [
    PR_SECURITY,
    PR_PERFORMANCE,
    REPO_SECURITY,
    CODE_SECURITY,
    CODE_PERFORMANCE,
    DIFF_SECURITY,
    DIFF_PERFORMANCE,
]

# Rank of each level and category in a review queue.
LEVEL_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
CATEGORY_RANK = {"security": 0, "performance": 1, "complexity": 2, "architecture": 3}


def catalogue(spark):
    """The rules as a table; the extension point for rules of one's own."""
    rows = [
        (r.rule_id, r.rule_ord, r.kind, r.type, r.level, r.pattern.regex, r.pattern.ignore_case, r.note, r.advice)
        for pack in ALL_PACKS
        for r in pack
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, rule_ord int, kind string, type string, level string, regex string, "
        "ignore_case boolean, note string, advice string",
    )


def from_table(df) -> list[Rule]:
    """Rules read back from a catalogue table (a few hundred rows, read once on the driver).

    A regex that is one of our own keeps its gates and its linear form.  Others are compiled here once, so
    that a broken one is named before any scan.
    """
    known = {(p.regex, p.ignore_case): p for p in PATTERNS.values()}
    compiled = df.sparkSession._jvm.java.util.regex.Pattern
    found = []
    for r in df.orderBy("rule_ord").collect():
        pattern = known.get((r.regex, r.ignore_case), Pattern(r.regex, (), r.ignore_case))
        rule = Rule(r.rule_id, r.rule_ord, r.kind, r.type, r.level, pattern, r.note, r.advice)
        try:
            compiled.compile(rule.java)
        except Exception as e:
            raise ValueError(f"rule {r.rule_id} has no valid regex: {r.regex}") from e
        found.append(rule)
    return found
