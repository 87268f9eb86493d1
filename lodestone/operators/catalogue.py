"""The rule catalogue: rules as data over four tables, each evaluated in one projection.

unit "line" tests raw lines, "code" lines with comments and strings blanked, "function" the masked body of each function,
"file" the whole text. A rule hits where `has` matches, every pattern of `also` matches, `lacks` does not, and the name (of the function, for functions; the
path, otherwise) matches `name`. Patterns stay in the syntax that Java and RE2 share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..parsers.mask import masked_files
from ..parsers.units import functions
from ..sources.text import lines

SCRIPT = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
TS, JS = ("ts", "tsx"), ("js", "jsx", "mjs", "cjs")
CPP = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp")
CODE = ("py", "go", "rs", "java", "cs", "kt", *SCRIPT, *CPP)
PROMPTS = ("md", "txt", "prompt", "yaml", "yml", "json")


@dataclass(frozen=True)
class CatalogueRule:
    id: str
    level: str
    unit: str
    langs: tuple[str, ...]
    has: str
    lacks: str = ""
    name: str = ""
    also: tuple[str, ...] = ()

    @property
    def section(self) -> str:
        return self.id.split(".")[0]


def _r(id: str, unit: str, langs: tuple[str, ...], has: str, lacks: str = "", name: str = "", also: tuple[str, ...] = (), level: str = "warn") -> CatalogueRule:
    return CatalogueRule(id, level, unit, langs, has, lacks, name, also)


def _pair(tail: str, unit: str, has: str, lacks: str = "", level: str = "warn", also: tuple[str, ...] = ()) -> list[CatalogueRule]:
    """One rule for TypeScript and its JavaScript sibling."""
    head, _, rest = tail.partition(".")
    return [_r(f"{head}.{lang}.{rest}", unit, langs, has, lacks, "", also, level) for lang, langs in (("typescript", TS), ("javascript", JS))]


_LOOP = r"(^|[^\w])(for|while|loop)([^\w]|$)"
_IN_LOOP = r"(?s)(^|[^\w])(for|while|loop)[^\w][^\n]*[:{{]\s*\n(.*\n)?[ \t]+[^\n]*({0})"
_WRITE = r"\.(save|insert|update|delete|commit|execute|exec|Exec|create|put|Put|persist|write|upsert)\w*\s*\("
_READ = r"\.(find|get|query|select|fetch|load|Query|QueryRow|read|scan)\w*\s*\("
_PUBLISH = r"\.(publish|emit|send|produce|enqueue|dispatch|Publish|Send)\w*\s*\("
_TX = r"(?i)transaction|begin_?tx|\bbegin\b|atomic|with_?tx|session\.begin|BeginTx"
_OUTBOUND = r"requests\.(get|post|put|delete|patch|request)\s*\(|http\.(Get|Post|Head|PostForm)\s*\(|fetch\s*\(|axios[.(]|urlopen\s*\(|httpx\.\w+\s*\("
_LOG = r"(?i)(^|[^\w.])(log|logger|logging|slog|console)\.\w+\s*\("

RULES: tuple[CatalogueRule, ...] = (
    # security
    _r("security.insecure-tls", "code", ("go",), r"InsecureSkipVerify\s*:\s*true", level="fail"),
    _r("security.python.insecure-tls", "code", ("py",), r"verify\s*=\s*False|_create_unverified_context|CERT_NONE|check_hostname\s*=\s*False", level="fail"),
    *_pair("security.insecure-tls", "line", r"rejectUnauthorized['\"]?\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED['\"]?\]?\s*=\s*['\"]?0", level="fail"),
    _r("security.java.insecure-tls", "code", ("java", "kt"), r"ALLOW_ALL_HOSTNAME_VERIFIER|NoopHostnameVerifier|TrustAllStrategy|setHostnameVerifier\s*\(\s*\([^)]*\)\s*->\s*true", level="fail"),
    _r("security.csharp.insecure-tls", "code", ("cs",), r"ServerCertificate(Custom)?ValidationCallback\s*\+?=.*(true|Dangerous)|DangerousAcceptAnyServerCertificateValidator", level="fail"),
    _r("security.ruby.insecure-tls", "line", ("rb",), r"VERIFY_NONE", level="fail"),
    _r("security.rust.insecure-tls", "code", ("rs",), r"danger_accept_invalid_(certs|hostnames)\s*\(\s*true", level="fail"),
    _r("security.cpp.insecure-tls", "code", CPP, r"CURLOPT_SSL_VERIFY(PEER|HOST)\s*,\s*(0L?|false)|SSL_VERIFY_NONE|set_verify_mode\s*\([^)]*verify_none", level="fail"),
    _r("security.shell-execution", "line", ("go",), r"exec\.Command(Context)?\s*\(.*['\"](sh|bash|cmd|powershell)['\"]"),
    _r("security.python.shell-execution", "code", ("py",), r"os\.(system|popen)\s*\(|subprocess\.\w+\(.*shell\s*=\s*True|commands\.getoutput"),
    *_pair("security.shell-execution", "code", r"(child_process|cp)\.(exec|execSync|spawn)\s*\(|(^|[^\w.])execSync\s*\("),
    _r("security.java.shell-execution", "code", ("java", "kt"), r"Runtime\.getRuntime\(\)\.exec|new\s+ProcessBuilder"),
    _r("security.csharp.shell-execution", "code", ("cs",), r"Process\.Start\s*\(|new\s+ProcessStartInfo"),
    _r("security.ruby.shell-execution", "line", ("rb",), r"(^|[^\w.])(system|exec|spawn)\s*[( ]['\"]|%x\{|Open3\."),
    _r("security.rust.shell-execution", "line", ("rs",), r"Command::new\s*\(\s*\"(sh|bash|cmd|powershell)"),
    _r("security.cpp.shell-execution", "code", CPP, r"(^|[^\w.>:])(std::)?(system|popen|_popen)\s*\("),
    _r("security.cpp.unsafe-c-api", "code", CPP, r"(^|[^\w.>])(std::)?(gets|strcpy|strcat|sprintf|vsprintf)\s*\("),
    _r("security.python.dynamic-code", "code", ("py",), r"(^|[^\w.])(eval|exec|compile)\s*\("),
    _r("security.ruby.dynamic-code", "line", ("rb",), r"(^|[^\w])(instance_eval|class_eval|eval)\s*[( ]"),
    *_pair("security.dynamic-code", "code", r"(^|[^\w.])eval\s*\(|new\s+Function\s*\("),
    *_pair("security.string-timer-code", "line", r"set(Timeout|Interval)\s*\(\s*['\"`]"),
    *_pair("security.postmessage-wildcard", "line", r"postMessage\s*\(.*,\s*['\"]\*['\"]"),
    *_pair("security.vm-dynamic-code", "code", r"(^|[^\w])vm\.(runIn\w*Context|compileFunction|Script)|new\s+vm\.Script"),
    *_pair("security.unsafe-html-sink", "code", r"\.(innerHTML|outerHTML)\s*\+?=[^=]|insertAdjacentHTML\s*\(|document\.write(ln)?\s*\(|dangerouslySetInnerHTML"),
    _r("security.bind-all-interfaces", "line", (), r"['\"]0\.0\.0\.0(:\d+)?['\"]"),
    _r("security.cors-wildcard", "line", (), r"(?i)access-control-allow-origin['\"]?\s*[,:)]\s*['\"]?\*|allow_origins\s*=\s*\[\s*['\"]\*|origin\s*:\s*['\"]\*['\"]"),
    _r("security.debug-enabled", "line", ("py", "rb", *SCRIPT), r"(?i)(^|[^\w])debug\s*=\s*true"),
    _r("security.dockerfile-root", "line", (), r"^\s*USER\s+(root|0)\s*$", name=r"(^|/)(Dockerfile[^/]*|[^/]*\.dockerfile)$"),
    _r("security.insecure-deserialization", "code", ("py", "java", "rb", "php", "cs"), r"pickle\.loads?\s*\(|yaml\.load\s*\(|marshal\.loads?\s*\(|ObjectInputStream\s*\(|Marshal\.load|BinaryFormatter", r"Safe_?Loader|safe_load"),
    _r("security.weak-cipher", "code", CODE, r"(^|[^\w])(DES|TripleDES|DES3|RC4|ARC4)\s*[.(]|des\.New(TripleDES)?Cipher|rc4\.NewCipher|MODE_ECB"),
    _r("security.weak-hash", "code", CODE, r"hashlib\.(md5|sha1)\s*\(|(^|[^\w])(md5|sha1)\.(New|Sum)\s*\(|MessageDigest\.getInstance\s*\(|Md5::new|MD5\.Create", r"(?i)usedforsecurity\s*=\s*False"),
    _r("security.log-secret-exposure", "code", CODE, _LOG + r".*(?i)(password|passwd|secret|token|api_?key|authorization|credential)"),
    _r("security.unsanitized-error-response", "code", ("go", "py", *SCRIPT), r"http\.Error\s*\(\s*\w+\s*,\s*err\.Error\(\)|res\.(send|json|end)\s*\(\s*\{?[^)]*(err|error)(\.(message|stack))?\s*\}?\)|return\s+(str|repr)\(e(rr|xc)?\)\s*,\s*5\d\d"),
    # prompts
    _r("prompts.secret-interpolation", "line", PROMPTS, r"(?i)(\{\{|\$\{|<%=?|\{)\s*[\w.]*(secret|token|password|api_?key|credential)[\w.]*\s*(\}\}|\}|%>)", name=r"(?i)prompt|agent|instruction|system", level="fail"),
    _r("prompts.unsafe-instructions", "line", PROMPTS, r"(?i)ignore (all |any |the )?(previous|prior|above) (instructions|rules)|(reveal|print|repeat) (the|your) (system|hidden) prompt|disregard (your|all) (rules|guidelines)", name=r"(?i)prompt|agent|instruction|system"),
    _r("prompts.agent-dangerous-instructions", "line", (), r"(?i)(skip|bypass|disable|without) (all |any |the )?(approvals?|sandbox(ing)?|permission checks?|confirmation|review)|never ask (for )?(permission|confirmation)", name=r"(^|/)(AGENTS\.md|\.cursorrules|copilot-instructions\.md)$", level="fail"),
    _r("prompts.agent-standing-permissions", "line", (), r"(?i)(allow|permissions?|approve)[^\n]{0,40}(\"\*\"|'\*'|\(\*\)|:\s*\*|all commands|everything)", name=r"(^|/)(AGENTS\.md|\.cursorrules|copilot-instructions\.md|settings(\.local)?\.json)$", level="fail"),
    _r("prompts.mcp-config-risk", "line", (), r"(?i)\"command\"\s*:\s*\"(sh|bash|cmd|powershell)\"|\"(tools|allowed_?tools)\"\s*:\s*\[\s*\"\*\"|curl [^|]*\|\s*(sh|bash)", name=r"(?i)mcp[^/]*\.json$", level="fail"),
    # quality of single lines
    *_pair("quality.ts-ignore", "line", r"@ts-ignore"), *_pair("quality.ts-expect-error", "line", r"@ts-expect-error"), *_pair("quality.ts-nocheck", "line", r"@ts-nocheck"),
    *_pair("quality.debugger-statement", "code", r"(^|[;{\s])debugger\s*(;|$)"), *_pair("quality.double-assertion", "code", r"as\s+unknown\s+as\s"), *_pair("quality.explicit-any", "code", r"[:<,]\s*any\s*([\]>,;)=|&]|$)|as\s+any([^\w]|$)"),
    *_pair("quality.non-null-assertion", "code", r"[\w)\]]!(\.|\[|;|,|\))"),
    _r("quality.ai.narrative-comment", "line", CODE, r"(?i)^\s*(//|#)\s*(now |then |first |next |finally |here )?(we |this |the code |let's )?(initiali[sz]e|create|set|get|loop|iterate|check|return|call|increment|define|import)s?\s+\w+(\s+\w+){0,7}\.?\s*$", r"(?i)because|since|so that|avoid|ensure|otherwise|workaround|due to|must|never"),
    _r("quality.ai.swallowed-error", "function", ("py",), r"except[^\n]*:\s*\n\s*(pass|\.\.\.)\s*(\n|$)"),
    _r("quality.ai.swallowed-error", "function", ("go", "java", "cs", "kt", *SCRIPT), r"catch\s*(\([^)]*\))?\s*\{\s*\}|(^|\n)\s*_\s*=\s*\w+(\.\w+)*\([^\n]*\)\s*(\n|$)|if err != nil \{\s*\}"),
    _r("quality.ai.dead-code", "code", CODE, r"(^|[^\w])if\s*\(?\s*(false|False|0)\s*\)?\s*[:{]|(^|[^\w])while\s*\(?\s*(false|False)\s*\)?\s*[:{]"),
    _r("quality.ai.over-mocked-test", "function", CODE, r"(?i)(mock|stub|patch|spy)[^\n]*\n(.*\n)*.*(mock|stub|patch|spy)[^\n]*\n(.*\n)*.*(mock|stub|patch|spy)", r"(?s)(assert|expect|require).*(assert|expect|require)", name=r"(?i)^test|^should|^it$"),
    _r("quality.environment-branching", "line", CODE, r"(?i)(^|[^\w])if[ (].*(env|environment|node_env|stage)\w*\s*\)?\s*(==|===|!=|in)\s*.{0,3}['\"](prod|production|staging|dev|development)['\"]"),
    _r("quality.mutable-global-state", "code", ("py",), r"^[a-z_][a-z0-9_]*\s*(:[^=]+)?=\s*(\[\]|\{\}|dict\(\)|list\(\)|set\(\))"),
    _r("quality.mutable-global-state", "code", ("go", *SCRIPT), r"^(var\s+\w+\s*=\s*(map|\[\])|(export\s+)?let\s+\w+)"),
    _r("quality.ambiguous-name", "code", CODE, r"(^|[^\w.])(data|manager|helper|thing|stuff|process|info|obj)\s*(:=|=[^=])"),
    _r("quality.boolean-argument", "function", CODE, r"^[^\n]*\([^)\n]*(:\s*bool(ean)?|\sbool|=\s*(True|False|true|false))\s*[,)]", name=r"^[a-z]"),
    _r("quality.hidden-side-effect", "function", CODE, _WRITE + "|" + _PUBLISH, name=r"(?i)^(get|find|is|has|build|format|compute|calculate|to)_?[A-Z_a-z]"),
    _r("quality.mixed-abstraction-levels", "function", CODE, r"(?i)(select |insert into|http\.|socket|open\s*\(|\.execute\s*\()", also=(r"(?i)(validate|approve|calculate|apply|process|notify|schedule)\w*\s*\([^\n]*\n(.*\n)*.*(validate|approve|calculate|apply|process|notify|schedule)\w*\s*\(",)),
    _r("quality.redundant-comment", "line", CODE, r"(?i)^\s*(//|#)\s*(constructor|getter|setter|default constructor|main function|end of \w+|import statements?|variables?|constants?)\.?\s*$"),
    _r("quality.primitive-obsession", "function", ("ts", "tsx", "java", "go", "cs"), r"^[^\n]*\([^)\n]*(string|String)[^)\n]*(string|String)[^)\n]*(string|String)[^)\n]*(string|String)"),
    _r("quality.duplicated-knowledge", "file", CODE, r"(?s)(['\"][a-z_]{12,}['\"]).*['\"](status|state|type|role)['\"].*['\"](status|state|type|role)['\"].*['\"](status|state|type|role)['\"]"),
    # errors
    _r("error.logged-and-returned", "function", CODE, _LOG + r"[^\n]*(err|error|exc|ex|e)\b[^\n]*\n\s*(return\s+[^\n]*\b(err|error)\b|raise\b|throw\b)"),
    _r("error.logged-and-ignored", "function", ("py", *SCRIPT), r"(except[^\n]*:|catch\s*\([^)]*\)\s*\{)\s*\n\s*(log|logger|logging|console)\.\w+\([^\n]*\)\s*\n\s*(return\s+(None|True|\[\]|\{\}|null|true)?\s*;?\s*(\n|$)|continue|\})"),
    _r("error.context-lost", "function", ("go",), r"if err != nil \{\s*\n\s*return (\w+, )*err\s*\n"),
    _r("error.context-lost", "function", ("py",), r"except\s+\w+[^\n]*:\s*\n\s*raise\s+\w+\([^\n]*\)\s*(\n|$)", r"\bfrom\s+\w+"),
    _r("error.generic-message", "line", CODE, r"(?i)(errors\.New|Error|Exception|fmt\.Errorf|raise \w+)\s*\(\s*['\"](error|failed|failure|something went wrong|an error occurred|unknown error|invalid|oops)[.!]?['\"]\s*\)"),
    _r("error.panic-on-recoverable-path", "function", ("go", "rs"), r"(^|[^\w.])panic!?\s*\(|\.unwrap\(\)|\.expect\(", name=r"(?i)handle|serve|parse|validate|load|read|request|process"),
    _r("error.cleanup-error-ignored", "code", ("go",), r"(^|\s)(defer\s+\w+(\.\w+)*\.(Close|Rollback)\(\)|_\s*=\s*\w+(\.\w+)*\.(Close|Rollback|Remove)\()"),
    _r("error.exception-used-for-control-flow", "function", ("py",), r"except\s+(StopIteration|KeyError|IndexError|AttributeError|ValueError)[^\n]*:\s*\n\s*(continue|break|return)"),
    _r("error.fallback-hides-corruption", "function", CODE, r"(?i)(except[^\n]*(json|decode|parse|unmarshal|corrupt)[^\n]*:|catch[^\n]*\{)\s*\n\s*return\s+(\{\}|\[\]|None|null|default\w*)"),
    _r("error.user-message-leaks-internals", "line", CODE, r"(?i)(message|detail|error)['\"]?\s*[:=]\s*[^\n]*(traceback|stack_?trace|\.stack\b|sql|format_exc)"),
    _r("error.partial-failure-hidden", "function", CODE, r"(?s)(for|while)[^\n]*[:{].*(except|catch|if err != nil)[^\n]*\n\s*continue.*return\s+(True|true|nil|None|success|ok)"),
    _r("error.retryable-not-distinguished", "function", CODE, r"(?i)(retry|attempt)\w*[^\n]*\n(.*\n)*.*(except( Exception)?\s*:|catch\s*\((e|err|error)\))", r"(?i)retryable|transient|temporary|timeout|status"),
    _r("error.inconsistent-wrapping", "function", ("go",), r"return[^\n]*fmt\.Errorf\(", also=(r"return (\w+, )*err\s*\n",)),
    _r("error.wrong-abstraction-level", "function", CODE, r"(?i)(raise|throw new|return)\s+[^\n]*(sql|http|redis|socket|driver)\w*(error|exception)", name=r"(?i)(service|domain|usecase|policy|order|invoice|account)"),
    # functions
    _r("function.command-query-mix", "function", CODE, r"return\s+[\w(\[{]", name=r"(?i)^(get|find|fetch|is|has|list|load)", also=(_WRITE,)),
    _r("function.hidden-mutation", "function", ("py", *SCRIPT), r"(^|\n)\s+(self|this)\.\w+\s*[-+*]?=[^=]|\.(append|push|pop|clear|update|splice)\s*\(", name=r"(?i)^(get|find|is|has|compute|calculate|format|build|parse|to)_?\w"),
    _r("function.inconsistent-return-contract", "function", ("py", *SCRIPT), r"(^|\n)\s+return\s*;?\s*(\n|$)", also=(r"(^|\n)\s+return\s+[\w(\[{'\"]",)),
    _r("function.mixed-abstraction-level", "function", CODE, r"(?i)(\.execute\s*\(|open\s*\(|socket\.|http\.|requests\.)", also=(r"(?i)(orchestrate|workflow|process|handle|approve|fulfil)\w*\s*\(",), name=r"(?i)process|handle|run|execute|orchestrate"),
    _r("function.multiple-responsibilities", "function", CODE, r"(?i)validat\w*\s*\(", also=(_WRITE, _PUBLISH)),
    _r("function.orchestration-domain-mix", "function", CODE, r"(?i)if[^\n]*(amount|price|balance|discount|quantity|total|limit)[^\n]*[<>]", name=r"(?i)handle|controller|job|worker|endpoint"),
    _r("function.partial-result", "function", ("go",), r"return\s+[a-z]\w*,\s*err\s*\n", r"return\s+(nil|\"\"|0|false),\s*err"),
    # naming
    _r("naming.boolean-not-predicate", "code", ("ts", "tsx", "go", "java"), r"(^|[^\w])(?:let|const|var|boolean)?\s*(\w*(flag|status|check|mode))\s*(:\s*boolean|\s+bool([^\w]|$))"),
    _r("naming.generic-identifier", "code", CODE, r"(^|[^\w.])(foo|bar|baz|tmp|temp2?|xxx|asdf)\s*(:=|=[^=]|\()"),
    _r("naming.missing-unit", "code", CODE, r"(?i)(^|[^\w])(timeout|delay|interval|duration|ttl|size|length_limit|amount)\s*(:\s*(int|number|float)\s*)?(:=|=)\s*\d{2,}"),
    _r("naming.implementation-leak", "function", CODE, r"\(", name=r"(?i)^(\w*order|\w*invoice|\w*customer|\w*account|\w*payment)\w*(sql|redis|kafka|http|mongo|postgres)"),
    _r("naming.behavior-mismatch", "function", CODE, r"return\s", r"=[^=]|\.(append|push|save|insert|update|delete|write|set|emit|publish)\w*\s*\(|print|log", name=r"(?i)^(save|delete|update|send|create|remove|write)_?[A-Z_]"),
    _r("naming.cardinality-mismatch", "code", CODE, r"(^|[^\w])(item|user|record|row|entry|name)\s*(:=|=)\s*(\[|list\()|(^|[^\w])(items|users|records|rows|entries|names)\s*(:=|=)\s*(None|null|nil|\d+|''|\"\")\s*;?$"),
    _r("naming.unknown-abbreviation", "code", CODE, r"(^|[^\w.])(usr|cstmr|prcs|mgr|svc|cnt|qty|acct|addr2|nmbr|vlu|hndlr|rslt)\s*(:=|=[^=])"),
    _r("naming.role-suffix-overuse", "file", CODE, r"(?s)(class|struct|type|interface)\s+\w+(Manager|Helper|Util|Utils|Service|Handler|Processor)([^\w].*(class|struct|type|interface)\s+\w+(Manager|Helper|Util|Utils|Service|Handler|Processor)){3}"),
    # data correctness
    _r("data.read-modify-write-race", "function", CODE, _READ, _TX + r"|(?i)lock|compare_?and_?swap|version|for update", also=(_WRITE,), level="fail"),
    _r("data.missing-transaction-boundary", "function", CODE, r"(?s)" + _WRITE + ".*" + _WRITE + ".*" + _WRITE, _TX, level="fail"),
    _r("data.side-effect-in-transaction", "function", CODE, r"(?is)(transaction|begin_?tx|atomic).*(" + _PUBLISH + "|" + _OUTBOUND + ")", level="fail"),
    _r("data.non-idempotent-consumer", "function", CODE, _WRITE + "|" + _PUBLISH, r"(?i)idempoten|dedup|already|processed|message_?id|seen", name=r"(?i)consum|on_?message|on_?event|handle_?(event|message)|subscriber", level="fail"),
    _r("data.missing-deduplication", "function", CODE, r"\w", r"(?i)dedup|idempoten|seen|message_?id|processed|unique", name=r"(?i)^(consume|on_?message|on_?event|handle_?(event|message))"),
    _r("data.unsafe-dual-write", "function", CODE, r"(?is)(db|repo|session|store|database)\w*" + _WRITE + r".*(cache|index|search|redis|elastic|queue)\w*\.(set|put|add|index|insert|write|push)\w*\s*\(", r"(?i)outbox|saga|compensat|transaction", level="fail"),
    _r("data.missing-outbox-strategy", "function", CODE, r"(?s)" + _WRITE + ".*" + _PUBLISH, r"(?i)outbox|cdc|transactional_?event", level="fail"),
    _r("data.unstable-pagination", "line", CODE, r"(?i)(limit\s+\S+\s+offset|\.offset\s*\(|offset\s*=\s*page)", r"(?i)order[ _]?by|cursor|\.order"),
    _r("data.unbounded-read", "line", CODE, r"(?i)['\"`]\s*select\s[^'\"`]*\sfrom\s[^'\"`]*['\"`]|\.objects\.all\s*\(\s*\)|\.findAll\s*\(\s*\)", r"(?i)limit|where|top\s+\d|cursor|count\("),
    _r("data.exactly-once-assumption", "line", CODE, r"(?i)exactly[- ]once|only (ever )?(delivered|processed|called) once|never (be )?(redelivered|retried)"),
    _r("data.cache-without-policy", "function", CODE, r"(?i)cache\w*\.(set|put|add|store)\s*\([^\n]*\)", r"(?i)ttl|expire|timeout|max_?age|invalidat|evict"),
    # reliability
    _r("reliability.missing-timeout", "function", ("py", "go", *SCRIPT), _OUTBOUND, r"(?i)timeout|deadline|signal|AbortController", level="fail"),
    _r("reliability.retry-without-backoff", "function", CODE, r"(?is)" + _LOOP + r".*(retry|retries|attempt)|(retry|retries|attempt)\w*.*" + _LOOP, r"(?i)backoff|sleep|delay|jitter|wait|after"),
    _r("reliability.unbounded-retry", "function", CODE, r"(?i)while\s*\(?\s*(True|true|1)\s*\)?\s*[:{](.*\n)+.*(retry|except|catch|err != nil)", r"(?i)max|attempt|limit|break|return|deadline", level="fail"),
    _r("reliability.non-idempotent-retry", "function", CODE, r"(?is)(retry|attempt)\w*.*\.(post|create|insert|charge|send|publish)\w*\s*\(", r"(?i)idempoten|dedup|request_?id", level="fail"),
    _r("reliability.swallowed-error", "function", CODE, r"(except[^\n]*:\s*\n\s*(pass|continue)\s*(\n|$))|catch\s*(\([^)]*\))?\s*\{\s*\}", level="fail"),
    _r("reliability.recoverable-panic", "function", ("go", "rs"), r"if err != nil \{\s*\n\s*(panic|log\.Fatal)|\.unwrap\(\)", level="fail"),
    _r("reliability.resource-leak", "function", ("py",), r"(^|\n)\s*\w+\s*=\s*open\s*\(", r"with\s+open|\.close\s*\(|contextlib|closing", level="fail"),
    _r("reliability.resource-leak", "function", ("go",), r"(os\.(Open|Create)|http\.Get|\.Query)\s*\(", r"\.Close\(\)", level="fail"),
    _r("reliability.missing-cancellation", "function", ("go",), r"context\.(Background|TODO)\(\)", name=r"(?i)handle|process|run|do|fetch|load"),
    _r("reliability.missing-concurrency-limit", "function", ("py", "go", *SCRIPT), r"(?s)" + _LOOP + r".*(go func|asyncio\.create_task|ensure_future|threading\.Thread|Promise\.all)", r"(?i)semaphore|limit|pool|errgroup|SetLimit|chunk|batch"),
    _r("reliability.missing-graceful-shutdown", "file", ("go", "py", *SCRIPT), r"ListenAndServe\s*\(|app\.listen\s*\(|serve_forever\s*\(", r"(?i)shutdown|SIGTERM|signal\.|graceful"),
    _r("reliability.unbounded-work", "function", ("go",), r"(?s)for[^\n]*\{.*go\s+(func|\w+\()", r"(?i)semaphore|errgroup|limit|pool|make\(chan"),
    _r("reliability.partial-failure-hidden", "function", CODE, r"(?s)(for|while)[^\n]*[:{].*(except|catch|err != nil)[^\n]*\n[^\n]*(log|print|continue).*return\s+(True|true|nil|None|success|ok)", level="fail"),
    _r("reliability.lost-error-context", "function", ("go",), r"if err != nil \{\s*\n\s*return[^\n]*errors\.New\(", r"%w"),
    # performance
    _r("performance.n-plus-one-query", "function", CODE, _IN_LOOP.format(r"\.(query|execute|find|findOne|findById|get_or_404|fetch|Query|QueryRow|select)\w*\s*\(|" + _OUTBOUND)),
    _r("performance.regex-compile-in-loop", "function", CODE, _IN_LOOP.format(r"re\.compile\s*\(|regexp\.(Must)?Compile\s*\(|new\s+RegExp\s*\(|Regex::new\s*\(|Pattern\.compile\s*\(")),
    _r("performance.string-concat-in-loop", "function", ("py", *SCRIPT), _IN_LOOP.format(r"\w+\s*\+=\s*(f?['\"`]|str\()")),
    _r("performance.go.alloc-in-loop", "function", ("go",), _IN_LOOP.format(r"\w+\s*\+=\s*(\"|fmt\.Sprintf)")), _r("performance.go.defer-in-loop", "function", ("go",), _IN_LOOP.format(r"defer\s")),
    _r("performance.go.sleep-in-loop", "function", ("go",), _IN_LOOP.format(r"time\.Sleep\s*\(")), _r("performance.go.timer-leak-in-loop", "function", ("go",), _IN_LOOP.format(r"time\.After\s*\(")),
    _r("performance.cpp.sleep-in-loop", "function", CPP, _IN_LOOP.format(r"sleep_(for|until)\s*\(")), _r("performance.cpp.alloc-in-loop", "function", CPP, _IN_LOOP.format(r"\w+\s*\+=\s*\"|\.append\s*\("), r"\.reserve\s*\("),
    _r("performance.cpp.unbounded-concurrency", "function", CPP, _IN_LOOP.format(r"std::(thread|async)\s*[({]|\.emplace_back\s*\(\s*\[")), _r("performance.cpp.flush-in-loop", "function", CPP, _IN_LOOP.format(r"std::endl|\.flush\s*\(")),
    _r("performance.rust.sleep-in-loop", "function", ("rs",), _IN_LOOP.format(r"thread::sleep\s*\(")), _r("performance.rust.alloc-in-loop", "function", ("rs",), _IN_LOOP.format(r"\.push_str\s*\(|\+=\s*&"), r"with_capacity"),
    _r("performance.unbounded-goroutines-in-loop", "function", ("go",), _IN_LOOP.format(r"go\s+(func|\w+\()"), r"(?i)semaphore|errgroup|make\(chan"),
    *_pair("performance.await-in-loop", "function", _IN_LOOP.format(r"await\s")), *_pair("performance.unbounded-concurrency", "function", _IN_LOOP.format(r"\.push\s*\(\s*(fetch|axios|\w+Async)|new\s+Promise"), r"(?i)limit|chunk|batch"),
    *_pair("performance.sync-io-in-handler", "function", r"\((req|request|ctx)\b[^)]*\)(.*\n)*.*\w+Sync\s*\("), *_pair("performance.express-sync-middleware", "file", r"(?s)express.*(hashSync|compareSync|pbkdf2Sync|scryptSync|deflateSync)\s*\("),
    *_pair("performance.timer-listener-leak", "file", r"setInterval\s*\(|addEventListener\s*\(", r"clearInterval\s*\(|removeEventListener\s*\("),
    *_pair("performance.react-expensive-render", "file", r"(?s)from ['\"]react['\"].*function [A-Z]\w*\([^)]*\)[^}]*\.(sort|filter|reduce)\s*\([^}]*\.(sort|map|reduce)\s*\(", r"useMemo"),
    _r("performance.python.sync-io-in-async", "function", ("py",), r"^async def[^\n]*\n(.*\n)*.*(requests\.\w+|urlopen|time\.sleep)\s*\("),
    _r("performance.python.unbounded-concurrency", "function", ("py",), _IN_LOOP.format(r"asyncio\.(create_task|ensure_future)\s*\("), r"(?i)semaphore|TaskGroup|limit"),
    _r("performance.python.orm-query-in-loop", "function", ("py",), _IN_LOOP.format(r"\.objects\.(get|filter)\s*\(|session\.(get|query)\s*\(")),
    _r("performance.python.django-nplusone-relation", "function", ("py",), r"for\s+\w+\s+in\s+\w+\.objects\.\w+\([^\n]*\)[^\n]*:\s*\n(.*\n)*?.*\w+\.\w+\.\w+", r"select_related|prefetch_related"),
    _r("performance.sync-io-in-request-path", "function", ("go",), r"http\.ResponseWriter(.*\n)*.*(os\.(ReadFile|Open|WriteFile)|ioutil\.ReadFile)\s*\("),
    _r("performance.unbounded-read", "function", ("go", "py"), r"io\.ReadAll\s*\(|\.read\(\)\s*(\n|$)", r"LimitReader|MaxBytesReader", name=r"(?i)handle|serve|upload|request|post|view"),
    # observability, operations, delivery
    _r("observability.sensitive-log-data", "code", CODE, _LOG + r"[^\n]*(?i)(password|passwd|token|authorization|secret|ssn|card_?number)", level="fail"),
    _r("observability.unstructured-log", "code", CODE, r"(^|[^\w.])(print|console\.log|fmt\.Print(ln|f)?|System\.out\.print(ln)?)\s*\("),
    _r("observability.error-without-context", "line", CODE, r"(?i)(log|logger|logging|console)\.(error|exception|warn)\s*\(\s*(err|error|e|exc|str\(e\)|['\"](error|failed)['\"])\s*\)"),
    _r("observability.high-cardinality-label", "line", CODE, r"(?i)(labels?|tags?|with_label_values|WithLabelValues)\s*[(=:{].*(user_?id|request_?id|email|session_?id|trace_?id|uuid)"),
    _r("observability.log-and-ignore", "function", CODE, r"(except[^\n]*:|catch\s*\([^)]*\)\s*\{|if err != nil \{)\s*\n\s*(log|logger|logging|console)\.\w+\([^\n]*\)\s*\n\s*(\}|return\s*$|return nil|continue|pass)"),
    _r("observability.shallow-health-check", "function", CODE, r"(?i)(200|['\"]ok['\"]|StatusOK|status.{0,4}up)", r"(?i)ping|db|redis|query|dependency|check", name=r"(?i)health|ready|liveness"),
    _r("observability.critical-path-uninstrumented", "function", CODE, _OUTBOUND + "|" + _WRITE, r"(?i)metric|trace|span|counter|histogram|log|observe", name=r"(?i)pay|charge|checkout|auth|login|transfer"),
    _r("delivery.missing-rollback-strategy", "file", ("yml", "yaml", "sh"), r"(?i)(kubectl apply|helm upgrade|terraform apply|deploy)", r"(?i)rollback|revert|restore|undo", name=r"(?i)deploy|release"),
    _r("delivery.missing-post-deploy-verification", "file", ("yml", "yaml", "sh"), r"(?i)(kubectl apply|helm upgrade|deploy)", r"(?i)smoke|health|verify|synthetic|slo|rollout status", name=r"(?i)deploy|release"),
    _r("delivery.unsafe-migration-order", "file", ("sql",), r"(?i)drop\s+(table|column)|alter\s+table[^;]*not\s+null", r"(?i)expand|backfill|concurrently|rollback|contract", name=r"(?i)migrat"),
    _r("delivery.high-risk-change-without-kill-switch", "function", CODE, _WRITE + "|" + _OUTBOUND, r"(?i)feature|flag|toggle|kill_?switch|enabled", name=r"(?i)charge|refund|checkout|authorize|migrate|billing"),
    _r("ci.mutable-deployment-reference", "line", ("yml", "yaml"), r"uses:\s*[\w./-]+@(main|master|v?\d+(\.\d+)*|latest)\s*$|image:\s*\S+:latest\s*$", level="fail"),
    _r("contracts.migration-destructive", "line", ("sql",), r"(?i)drop\s+table|drop\s+column|truncate\s|alter\s+[^;]*set\s+not\s+null", r"(?i)default", name=r"(?i)migrat"),
    _r("contracts.non-expand-contract-migration", "file", ("sql",), r"(?i)(rename\s+column|drop\s+column|alter\s+column[^;]*type)", r"(?i)expand|backfill|contract", name=r"(?i)migrat", level="fail"),
    _r("supply_chain.missing-provenance", "file", ("yml", "yaml"), r"(?i)(docker push|npm publish|twine upload|cargo publish|goreleaser|gh release create)", r"(?i)provenance|attest|cosign|slsa|sigstore", level="fail"),
    _r("supply_chain.cargo.non-hermetic-source", "line", ("toml",), r"(?i)^\s*[\w-]+\s*=\s*\{[^}]*(path\s*=|branch\s*=)", name=r"Cargo\.toml$"),
    _r("supply_chain.cargo.missing-package-license", "file", ("toml",), r"\[package\]", r"(?m)^license(-file)?\s*=", name=r"Cargo\.toml$"),
    # design, smells, defensive, testing
    _r("design.generic-package-name", "file", ("go",), r"(?m)^package\s+(util|utils|common|helpers?|misc|shared|base|lib)\s*$"),
    _r("design.python.generic-module-name", "file", ("py",), r"", name=r"(^|/)(utils?|helpers?|common|misc|stuff|shared)\.py$"),
    _r("design.typescript.generic-module-name", "file", SCRIPT, r"", name=r"(^|/)(utils?|helpers?|common|misc|stuff|shared)\.[cm]?[jt]sx?$"),
    _r("design.cpp.generic-module-name", "file", CPP, r"", name=r"(^|/)(utils?|helpers?|common|misc|stuff|shared)\.(c|cc|cpp|cxx|h|hh|hpp)$"),
    _r("design.domain-logic-in-handler", "function", CODE, r"(?i)if[^\n]*(amount|price|balance|discount|eligib|limit|quota)[^\n]*\n(.*\n)*.*if[^\n]*(amount|price|balance|discount|eligib|limit|quota)", name=r"(?i)handler|controller|endpoint|view"),
    _r("design.configuration-leak", "code", CODE, r"os\.environ|os\.Getenv|process\.env|System\.getenv", name=r"(?i)(^|/)(domain|model|entity|core)/"),
    _r("design.infrastructure-type-leak", "code", CODE, r"(^|[^\w])(sql\.(DB|Rows|Tx)|http\.(Request|ResponseWriter)|Session|boto3|redis\.Client)([^\w]|$)", name=r"(?i)(^|/)(domain|api|public)/"),
    _r("design.persistence-model-leak", "code", CODE, r"(?i)return\s+\w*(Entity|Record|Row|Model)\b", name=r"(?i)(handler|controller|api)"),
    _r("design.temporal-coupling", "function", CODE, r"(?i)(must|call)\s+\w*(init|setup|configure|open)\w*\s+(first|before)|if not self\._?(initialized|ready|connected)"),
    _r("design.pass-through-abstraction", "function", CODE, r"^[^\n]*\n\s*return\s+(self|this)\.\w+\.\w+\([^\n]*\)\s*;?\s*(\n\s*\})?\s*$"),
    _r("smell.message-chain", "code", CODE, r"\w+(\.\w+\(\)){4,}|(\w+\.){5,}\w+\("),
    _r("smell.switch-on-type", "function", CODE, r"(?s)(isinstance\s*\(|instanceof\s|\.kind\s*===?|\.type\s*===?|case\s+\*?\w+:).*(isinstance\s*\(|instanceof\s|\.kind\s*===?|\.type\s*===?).*(isinstance\s*\(|instanceof\s|\.kind\s*===?|\.type\s*===?)"),
    _r("smell.refused-bequest", "file", CODE, r"(?s)(NotImplementedError|UnsupportedOperationException|not supported).*(NotImplementedError|UnsupportedOperationException|not supported)", r"(?i)abstract|ABC|Protocol"),
    _r("defensive.unchecked-type-assertion", "code", ("go",), r"(^|\s)\w+\s*:?=\s*\w+(\.\w+)*\.\(\*?[\w.]+\)\s*$"),
    _r("defensive.unsafe-numeric-conversion", "code", ("go",), r"(^|[^\w])(u?int(8|16|32))\s*\(\s*\w+(\.\w+)*\s*\)"),
    _r("defensive.missing-schema-validation", "function", CODE, r"json\.(loads|Unmarshal|NewDecoder|parse)\s*\(|JSON\.parse\s*\(|request\.json", r"(?i)valid|schema|pydantic|zod|joi|Decode\w*Strict|DisallowUnknown"),
    _r("defensive.unvalidated-boundary-input", "function", CODE, r"(?i)request\.(args|form|json|params|query|body)|req\.(params|query|body)|r\.(URL\.Query|FormValue)", r"(?i)valid|sanitiz|schema|parse_?int|Atoi|isinstance|check"),
    _r("defensive.unchecked-external-response", "function", ("py", "go", *SCRIPT), _OUTBOUND, r"(?i)status|raise_for_status|\.ok\b|StatusCode"),
    _r("defensive.missing-resource-limit", "function", CODE, r"(?i)(upload|read_?all|ReadAll|\.read\(\))", r"(?i)limit|max|size|chunk", name=r"(?i)upload|import|receive|ingest"),
    _r("defensive.fail-open-authorization", "function", CODE, r"(?s)(except|catch|err != nil)[^\n]*\n\s*return\s+(True|true|nil|allow)", name=r"(?i)auth|permit|allow|access|can_"),
    _r("defensive.unsafe-default", "line", CODE, r"(?i)(getenv|environ\.get|process\.env\.\w+\s*\|\|)[^\n]*(secret|verify|auth|secure|tls)[^\n]*['\",|]\s*(false|off|0|none|disabled|changeme)"),
    _r("defensive.sequence-collision-risk", "code", CODE, r"(?i)(id|seq|number|no)\s*(:=|=)\s*(len|count|\w*\.count|\w*\.length)\W[^\n]*\+\s*1"),
    _r("defensive.non-exhaustive-branch", "function", ("go", "java", "cs", *SCRIPT), r"switch\s*\(?\s*\w*(\.)?(state|kind|type|status|role)\b", r"default\s*:"),
    _r("defensive.invalid-state-transition", "function", CODE, r"(?i)\.(status|state)\s*=\s*\S*(done|closed|completed|cancelled|paid|shipped)", r"(?i)if[^\n]*(status|state)"),
    _r("defensive.bounds-assumption", "code", ("py", "go", *SCRIPT), r"(^|[^\w])\w+(\.split\([^)]*\))\[\d+\]|(args|argv|parts|fields)\[\d+\]"),
    _r("defensive.integer-overflow", "code", ("go", "java", "rs", *CPP), r"(^|[^\w])(int32|int|u32|i32|short)\s*\(?\s*\w+\s*\*\s*\w+\s*\*\s*\w+"),
    _r("defensive.null-assumption", "code", SCRIPT + ("java", "kt", "cs"), r"\.(find|get|getElementById|querySelector)\([^)]*\)\.\w+"),
    _r("defensive.invalid-state-representable", "code", ("ts", "tsx", "go", "java"), r"(?i)is(loading|success|error)\s*[:?].*bool.*is(loading|success|error)"),
    _r("testing.nondeterministic-domain-logic", "function", CODE, r"datetime\.(now|utcnow)\(|time\.(time|Now)\(\)|Date\.now\(|new Date\(\)|random\.\w+\(|Math\.random\(|rand\.\w+\(|uuid4\(", name=r"(?i)calculate|compute|price|apply|decide|evaluate|score"),
    _r("testing.hardwired-dependency", "function", CODE, r"(^|\n)\s*(self|this)?\.?\w+\s*:?=\s*(requests\.Session|http\.Client\{|&http\.Client|new \w*Client|boto3\.\w+|psycopg2\.connect|redis\.Redis|sqlite3\.connect)\s*[({]?", name=r"(?i)process|calculate|handle|run|apply"),
    _r("testing.failure-path-missing", "file", CODE, r"(?i)def test_|func Test|it\(['\"]", r"(?i)raises|error|fail|invalid|throws|reject|exception", name=r"(?i)(^|/)test_|_test\.|\.test\.|\.spec\."),
)


def rules_table(spark: SparkSession, rules: tuple[CatalogueRule, ...] = RULES) -> DataFrame:
    """(rule_id, section, default_level, unit, languages), one row for each rule id."""
    rows: dict[str, tuple] = {}
    for r in rules:
        held = rows.get(r.id)
        rows[r.id] = (r.id, r.section, r.level, r.unit, sorted({*r.langs, *(held[4] if held else ())}))
    return spark.createDataFrame(list(rows.values()), "rule_id string, section string, default_level string, unit string, languages array<string>")


def _test(rule: CatalogueRule, text: Column, lang: Column, name: Column) -> Column:
    test = lang.isin(*rule.langs) if rule.langs else F.lit(True)
    if rule.name:
        test &= name.rlike(rule.name)
    for pattern in (rule.has, *rule.also):
        if pattern:
            test &= text.rlike(pattern)
    return test & ~text.rlike(rule.lacks) if rule.lacks else test


def _hits(rules: list[CatalogueRule], text: Column, lang: Column, name: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.when(_test(r, text, lang, name), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.level).alias("severity"))) for r in rules))))


def _of(unit: str, rules: tuple[CatalogueRule, ...]) -> list[CatalogueRule]:
    return [r for r in rules if r.unit == unit]


def run_catalogue(files: DataFrame, rules: tuple[CatalogueRule, ...] = RULES) -> DataFrame:
    """(rule_id, section, severity, path, line, message) of all rules over files (path, text, lang). Each unit's rules share one pass."""
    f = files.select("path", F.coalesce("text", F.lit("")).alias("text"), F.lower("lang").alias("lang"))
    t, lang, path = F.col("line_text"), F.col("lang"), F.col("path")
    parts = []
    if own := _of("line", rules):
        parts.append(lines(f).select("path", "line", F.explode(_hits(own, t, lang, path)).alias("h"), F.lit(None).cast("string").alias("name")))
    if own := _of("code", rules):
        parts.append(lines(masked_files(f)).select("path", "line", F.explode(_hits(own, t, lang, path)).alias("h"), F.lit(None).cast("string").alias("name")))
    if own := _of("function", rules):
        parts.append(functions(f).select("path", F.col("first").alias("line"), F.explode(_hits(own, F.col("body"), F.lower("lang"), F.col("name"))).alias("h"), "name"))
    if own := _of("file", rules):
        parts.append(f.select("path", F.lit(None).cast("int").alias("line"), F.explode(_hits(own, F.col("text"), lang, path)).alias("h"), F.lit(None).cast("string").alias("name")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rule = F.col("h.rule_id")
    return found.select(rule.alias("rule_id"), F.split(rule, "[.]")[0].alias("section"), F.col("h.severity").alias("severity"), "path", "line", F.concat_ws(" in ", rule, "name").alias("message"))
