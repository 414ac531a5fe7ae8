"""Term tables: lexicons, aliases, reserved words, from text files; as lists on the driver or as rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

CATEGORIES = ("action_verbs", "state_indicators", "permission_terms", "restriction_terms", "role_nouns", "object_domain_terms", "condition_indicators", "transition_indicators", "heading_relevant_terms")

#: Default terms by category.
DEFAULT_TERMS = {
    "action_verbs": "perform execute submit approve reject edit view create delete update validate confirm cancel".split(),
    "state_indicators": "state status pending completed active inactive draft approved rejected".split(),
    "permission_terms": "permission may allowed can authorized entitled grant access".split(),
    "restriction_terms": ["restriction", "must not", "prohibited", "forbidden", "cannot", "shall not", "denied", "blocked"],
    "role_nouns": "user admin system administrator role actor approver validator".split(),
    "object_domain_terms": "document request record form application workflow task action".split(),
    "condition_indicators": ["condition", "when", "if", "unless", "whenever", "provided that", "in case"],
    "transition_indicators": ["transition", "change to", "moves to", "becomes", "from ... to"],
    "heading_relevant_terms": "process procedure status role permission restriction rules policy actions workflow validation".split(),
}
#: Queries of the TF-IDF score.
SEEDED_QUERIES = ["user action", "system action", "state transition", "permission", "restriction", "validation rule", "approval", "workflow step"]

#: Russian terms by category, most of them stems.
RUSSIAN_TERMS = {
    "action_verbs": "выполн созда удал измен подтвержд отмен отклон утвержд отправ редакт просмотр отправл редактир копир загруз сохран добавл удален изменен".split(),
    "condition_indicators": ["услови", "если", "когда", "при", "в случае", "при условии", "если только"],
    "heading_relevant_terms": "процесс процедур статус роль разрешен ограничен правил политик действи рабоч поток проверк валидац".split(),
    "object_domain_terms": "документ заявк запрос запис форма приложен процесс задач действи операци".split(),
    "permission_terms": "разреш мож прав дозвол разреша разрешен".split(),
    "restriction_terms": "запрет нельз обяз долж должен запреща запрещен обязан обязанн".split(),
    "role_nouns": "пользовател админ систем роль администратор исполнитель утверждающ проверяющ".split(),
    "state_indicators": "состояни статус ожидан заверш актив неактив черновик утвержд отклонен выполнен".split(),
    "transition_indicators": "переход изменен становит преобраз перевод".split(),
}
#: Russian queries of the TF-IDF score.
RUSSIAN_QUERIES = ["действие пользователя", "действие системы", "переход состояния", "разрешение", "ограничение", "правило проверки", "согласование", "шаг процесса"]


def with_russian(terms: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Terms with the Russian ones of their category after them."""
    return {k: [*v, *RUSSIAN_TERMS.get(k, [])] for k, v in (terms or DEFAULT_TERMS).items()}


def term_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(category, term) of the files ``<category>.txt`` and ``<category>_ru.txt`` under a folder, each pair once.

    A file may also be a folder of that name that Spark wrote. Lines are treated as by ``parse_terms``."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder)
    category = F.regexp_extract(F.input_file_name(), r"[/=]([a-z_]+?)(?:_ru)?\.txt(?:/|$)", 1)
    rows = lines.select(category.alias("category"), F.lower(t.strip(F.col("value"))).alias("term"))
    return rows.where("term <> '' and not startswith(term, '#') and category <> ''").distinct()


def parse_terms(text: str) -> list[str]:
    """Stripped lower-case lines that are neither empty nor comments."""
    lines = (line.strip() for line in text.splitlines())
    return [line.lower() for line in lines if line and not line.startswith("#")]


def read_term_tables(folder: str, categories: tuple[str, ...] = CATEGORIES) -> dict[str, list[str]]:
    """Terms by category, with those of ``<category>_ru.txt`` after them; a missing category is an error."""
    out = {}
    for name in categories:
        out[name] = parse_terms((Path(folder) / f"{name}.txt").read_text("utf-8"))
        more = Path(folder) / f"{name}_ru.txt"
        out[name] += parse_terms(more.read_text("utf-8")) if more.exists() else []
    return out


def parse_aliases(text: str, slug) -> dict[str, str]:
    """``a -> b`` or ``a = b`` lines, both sides as slugs; an empty right side stands for the left."""
    out = {}
    for line in parse_terms(text):
        left, _, right = line.partition("->") if "->" in line else line.partition("=")
        if key := slug(left):
            out[key] = slug(right) or key
    return out
