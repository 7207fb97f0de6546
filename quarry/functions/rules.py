"""Rules as data. A condition is SQL that Spark and DuckDB both read, over lower-case columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has(field: str, *needles: str) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(field, n.replace("'", "''")) for n in needles) + ")"


def rx(field: str, pattern: str) -> str:
    return "regexp_like({}, r'{}')".format(field, pattern)


def any_of(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def duck(condition: str) -> str:
    return condition.replace("regexp_like(", "regexp_matches(").replace(", r'", ", '")


def first_of(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{label}'" for label, c in rules) + f" ELSE '{default}' END"


def all_of(rules: list[tuple[str, str]]) -> list[str]:
    return [f"CASE WHEN {c} THEN '{label}' END" for label, c in rules]


def labels(rules: list[tuple[str, str]], *before: Column, cap: int | None = None) -> Column:
    """The labels whose conditions hold, in the order of the rules, behind the columns ``before``; each once."""
    found = F.array_distinct(F.array_compact(F.array(*before, *map(F.expr, all_of(rules)))))
    return F.slice(found, 1, cap) if cap else found


def duck_labels(rules: list[tuple[str, str]], *before: str, cap: int | None = None) -> str:
    parts = ", ".join([*before, *map(duck, all_of(rules))])
    out = f"list_filter(list_filter([{parts}], lambda x: x IS NOT NULL), lambda x, i: list_position(list_filter([{parts}], lambda y: y IS NOT NULL), x) = i)"
    return f"{out}[1:{cap}]" if cap else out


# What the rules look for, in the order in which they are tried.
CHUNK_DOMAIN = [
    ("tests", any_of(has("path", "test", "spec"), has("title", "test"))),
    ("auth", any_of(has("content", "jwt", "oauth", "bcrypt"), has("title", "auth"))),
    ("security", has("content", "encrypt", "decrypt", "hash", "crypto")),
    ("database", has("content", "select ", "insert ", "query(", ".find(", ".save(")),
    ("logging", has("content", "log.", "logger.", "console.log")),
    ("messaging", has("content", "emit(", "publish(", "subscribe(", "queue")),
    ("config", any_of(has("path", "config", ".env"), has("content", "process.env"))),
    ("infra", has("path", "infra", "terraform", "docker")),
    ("frontend", has("content", "render(", "component", "usestate", "jsx")),
    ("backend", has("content", "router", "route", "controller", "handler")),
    ("docs", any_of(has("path", "docs", "readme"), "kind = 'section'")),
    ("utils", has("path", "util", "helper")),
]
CHUNK_PATTERNS = [
    ("singleton", any_of(has("content", "singleton"), rx("content", r"static\s+instance\s*="))),
    ("factory", any_of(has("content", "factory"), rx("content", r"create\w+\("))),
    ("repository", any_of(has("content", "repository"), rx("content", r"\.find\(|\.save\(|\.delete\("))),
    ("service", has("content", "service") + " AND " + has("content", "class", "function")),
    ("controller", any_of(rx("content", r"app\.(get|post|put|delete|patch)\("), has("content", "router."))),
    ("middleware", has("content", "next(", "middleware")),
    ("observer", has("content", "eventemitter", ".on(", ".emit(")),
    ("decorator", any_of(rx("content", r"@\w+\s*\n?\s*(class|function|method)"), has("content", "@injectable"))),
    ("strategy", any_of(has("content", "strategy"), rx("content", r"interface\s+i\w+strategy"))),
    ("command", any_of(has("content", "command"), rx("content", r"interface\s+i\w+command"))),
]
CHUNK_TAGS = [
    ("async", has("content", "async", "await")),
    ("promise", has("content", "promise", ".then(")),
    ("class", has("content", "class ")),
    ("interface", has("content", "interface ")),
    ("exported", has("content", "export")),
    ("has-imports", has("content", "import")),
    ("error-handling", has("content", "error", "exception", "catch")),
    ("test", has("content", "test", "expect(", "assert")),
    ("has-todos", has("content", "todo", "fixme", "hack")),
    ("deprecated", has("content", "deprecated")),
    ("public-api", has("content", "public", "export default")),
    ("private", has("content", "private", "#")),
    ("abstract", has("content", "abstract")),
    ("generic", any_of(has("content", "generic"), rx("content", r"<[a-z]\w*>"))),
    ("recursive", has("content", "recursive")),
    ("regex", any_of(has("content", "regex", "regexp"), rx("content", r"/[^/]+/[gimsuy]*"))),
    ("sql", has("content", "sql", "select ", "insert ")),
    ("http", has("content", "http", "fetch(", "axios")),
    ("websocket", has("content", "websocket", "ws://", "socket.io")),
    ("graphql", has("content", "graphql", "gql`")),
    ("grpc", has("content", "grpc", "protobuf")),
    ("test-file", has("path", "test", "spec")),
    ("migration", has("path", "migration")),
    ("seed", has("path", "seed")),
    ("config-file", has("path", "config")),
]
CHUNK_EFFECTS = [
    ("console-output", has("content", "console.log", "console.error", "console.warn")),
    ("process-exit", has("content", "process.exit")),
    ("file-system-write", has("content", "writefile", "appendfile", "unlink", "rmdir")),
    ("state-mutation", has("content", "setstate", "dispatch(", "store.")),
    ("event-emission", has("content", "emit(", "publish(", "broadcast(")),
    ("database-write", has("content", "insert", "update", "delete", ".save(")),
    ("email-send", has("content", "send(", "sendmail", "smtp", "nodemailer")),
    ("timer", has("content", "settimeout", "setinterval")),
    ("global-mutation", has("content", "global.", "window.", "globalthis.")),
    ("env-read", has("content", "process.env")),
    ("network-call", has("content", "http.", "fetch(", "axios.")),
]
RESPONSIBILITIES = [
    ("validation", has("content", "validate", "validation")),
    ("authentication", has("content", "auth", "token", "jwt")),
    ("database", has("content", "database", "query", "sql", "db.")),
    ("http-client", has("content", "http", "fetch", "axios", "request")),
    ("logging", has("content", "log", "logger", "console.")),
    ("caching", has("content", "cache", "redis", "memcache")),
    ("event-handling", has("content", "event", "emit", "subscribe")),
    ("data-transformation", has("content", "transform", "map(", "filter(")),
    ("error-handling", has("content", "error", "exception", "catch")),
    ("configuration", has("content", "config", "env", "settings")),
    ("testing", has("content", "test", "expect", "assert")),
    ("ui-rendering", has("content", "render", "component", "jsx")),
    ("serialization", has("content", "parse", "serialize", "deserialize")),
    ("cryptography", has("content", "encrypt", "decrypt", "hash")),
    ("file-io", has("content", "file", "fs.", "readfile")),
    ("async-processing", has("content", "queue", "worker", "job")),
    ("database-migration", has("content", "migrate", "migration", "schema")),
]
SUMMARY_EFFECTS = [
    ("console-output", has("content", "console.log", "console.error")),
    ("process-exit", has("content", "process.exit")),
    ("file-write", has("content", "writefile", "appendfile", "unlink")),
    ("state-mutation", has("content", "setstate", "dispatch(", "store.")),
    ("event-emission", has("content", "emit(", "publish(")),
    ("database-write", has("content", "insert", "update", "delete", "save(")),
    ("external-communication", has("content", "send(", "sendmail", "smtp")),
]
FILE_DOMAIN = [
    ("tests", has("path", "test", "spec", "__tests__")),
    ("auth", any_of(has("path", "auth"), has("content", "jwt", "oauth"))),
    ("security", any_of(has("path", "security"), has("content", "encrypt", "bcrypt"))),
    ("database", has("path", "database", "db", "migration", "repository")),
    ("config", has("path", "config", "settings", ".env")),
    ("logging", any_of(has("path", "log"), has("content", "pino", "winston"))),
    ("messaging", has("path", "message", "queue", "kafka", "rabbitmq")),
    ("infra", has("path", "infra", "terraform", "docker", "k8s")),
    ("frontend", has("path", "component", "page", "view", "ui")),
    ("backend", has("path", "api", "route", "controller", "handler")),
    ("docs", any_of(has("path", "docs", "readme"), "type = 'documentation'")),
    ("utils", has("path", "util", "helper", "common")),
]
FILE_ROLE = [
    ("HTTP controller handling requests and responses", has("path", "controller")),
    ("Business logic service layer", has("path", "service")),
    ("Data access layer / repository pattern", has("path", "repository", "repo")),
    ("Middleware for request/response pipeline", has("path", "middleware")),
    ("Data model / entity definition", has("path", "model", "entity", "schema")),
    ("Route definitions and URL mapping", has("path", "router", "routes")),
    ("Configuration and settings management", has("path", "config")),
    ("Utility functions and helpers", has("path", "util", "helper")),
    ("Test suite", has("path", "test", "spec")),
    ("Module entry point / barrel file", has("path", "index")),
    ("Database migration", has("path", "migration")),
    ("Database seed data", has("path", "seed")),
    ("Documentation", "type = 'documentation'"),
    ("Configuration file", "type = 'config'"),
]
# Upper-case needles in lower-case text: the last rule never holds, as in the semantics followed here.
FILE_TAGS = [
    ("async", has("content", "async", "await", "promise")),
    ("oop", has("content", "class ")),
    ("typed", has("content", "interface ", "type ")),
    ("exported", has("content", "export default", "module.exports")),
    ("test", has("path", "test", "spec")),
    ("has-todos", has("content", "TODO", "FIXME", "HACK")),
]
FRAMEWORKS = [
    ("Express", any_of(has("content", "express"), has("path", "express"))),
    ("Fastify", any_of(has("content", "fastify"), has("path", "fastify"))),
    ("NestJS", has("content", "nestjs")),
    ("React", has("content", "react", "jsx")),
    ("Vue", has("content", "vue", "nuxt")),
    ("Angular", has("content", "angular")),
    ("Django", any_of(has("content", "django"), has("path", "django"))),
    ("FastAPI", has("content", "fastapi")),
    ("Flask", has("content", "flask")),
    ("Spring", has("content", "spring")),
    ("Gin", has("content", "gin.", '"github.com/gin-gonic')),
    ("Actix", has("content", "actix")),
    ("Next.js", any_of(has("content", "next/"), has("path", "next.config"))),
    ("Prisma", any_of(has("content", "prisma"), has("path", "prisma"))),
    ("TypeORM", has("content", "typeorm", "@entity")),
]
PROJECT_PATTERNS = [
    ("repository", has("path", "repository", "repo")),
    ("service", any_of(has("path", "service"), has("content", "service layer"))),
    ("controller", has("path", "controller", "handler")),
    ("middleware", has("path", "middleware")),
    ("singleton", has("content", "singleton", "instance =")),
    ("factory", has("content", "factory", "createinstance")),
    ("observer", has("content", "observer", "eventemitter")),
    ("decorator", has("content", "decorator", "@injectable")),
    ("command", has("content", "command", "icommand")),
    ("cqrs", has("content", "cqrs", "queryhandler")),
    ("ddd", has("content", "domain", "aggregate")),
    ("event-driven", has("content", "event-driven", "eventbus")),
]
#: Each purpose needs every one of its conditions to hold in some file.
PURPOSES = [
    ("REST API backend service", [has("path", "api"), has("content", "route", "endpoint")]),
    ("Frontend web application", [has("content", "react", "vue", "angular")]),
    ("Command-line tool", [has("content", "cli", "commander", "argv")]),
    ("Microservice", [has("content", "microservice", "grpc")]),
    ("Machine learning project", [has("content", "machine learning", "tensorflow", "pytorch")]),
    ("Infrastructure as code", [has("path", "terraform", "kubernetes", "helm")]),
    ("Library / package", [has("content", "library", "npm publish", "package")]),
]
