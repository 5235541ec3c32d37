"""Paths, repositories, layers and links as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path pieces of files that belong to no layer.
NO_LAYER = ("/test/", "/tests/", "/androidtest/", "/build/", "/.gradle/", "/generated/", "/build-output/")
# Layers by stack, in the order in which they are tried: folders anywhere in the path, then endings of the file name, then parts of it.
LAYERS = {
    "spring": (
        ("spring_dto_mapper", ("/dto/", "/mapper/"), ("dto.java", "mapper.java", "converter.java"), ()),
        ("spring_controller", ("/controller/", "/web/", "/api/", "/rest/"), ("controller.java", "restcontroller.java"), ()),
        ("spring_service", ("/service/", "/usecase/", "/application/"), ("service.java", "serviceimpl.java"), ()),
        ("spring_repository", ("/repository/", "/repositories/", "/persistence/", "/infrastructure/"), ("repository.java", "dao.java"), ()),
        ("spring_entity", ("/entity/", "/entities/", "/model/", "/models/", "/domain/"), (), ()),
        ("spring_config_security", ("/configuration/", "/config/", "/security/"), ("config.java", "configuration.java", "filter.java"), ()),
    ),
    "android": (
        ("android_fragment", ("/fragment/", "/fragments/"), ("fragment.java", "fragment.kt"), ()),
        ("android_viewmodel", ("/viewmodel/", "/viewmodels/"), ("viewmodel.java", "viewmodel.kt"), ()),
        ("android_recyclerview", (), ("adapter.java", "adapter.kt", "viewholder.java", "viewholder.kt"), ()),
        ("android_activity", (), ("activity.java", "activity.kt"), ()),
        ("android_navigation", ("/navigation/",), (), ("navgraph", "navcontroller")),
        ("android_retrofit", ("/retrofit/", "/api/"), ("apiservice.java", "apiservice.kt", "apiclient.java", "apiclient.kt"), ()),
        ("android_room", ("/room/",), ("dao.java", "dao.kt", "database.java", "database.kt"), ()),
        ("android_repository", ("/data/", "/repository/", "/repositories/"), ("repository.java", "repository.kt"), ()),
    ),
}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def layer_of(path: Column, stack: Column) -> Column:
    """The layer of a source file in a spring or android repository; null for tests, generated files and what fits none."""
    p, name = F.lower(path), base_name(F.lower(path))
    source = p.endswith(".java") | p.endswith(".kt")
    out = F.when(_any([p.contains(x) for x in NO_LAYER]), F.lit(None).cast("string"))
    out = out.when((stack == "android") & p.endswith(".xml") & p.contains("/res/layout"), "android_layout")
    out = out.when((stack == "android") & ~source, F.lit(None).cast("string"))
    for which, layers in LAYERS.items():
        for layer, folders, endings, parts in layers:
            fits = _any([p.contains(x) for x in folders] + [name.endswith(x) for x in endings] + [name.contains(x) for x in parts])
            out = out.when((stack == which) & fits, layer)
    return out


def repo_type(repo: Column) -> Column:
    """android or spring by the repository's own name, else null."""
    short = F.lower(base_name(repo))
    fits = lambda kind: short.startswith(kind) | short.contains(f"-{kind}")
    return F.when(fits("android"), "android").when(fits("spring"), "spring")


def repo_kind(repo: Column) -> Column:
    """android by the full name, else spring."""
    low = F.lower(repo)
    return F.when(low.startswith("android") | low.contains("-android") | low.contains("/android"), "android").otherwise("spring")


def source_suffixes(repo: Column) -> Column:
    """File endings that count as code in a repository."""
    return F.when(F.lower(base_name(repo)).startswith("spring"), F.array(F.lit(".java"))).otherwise(F.array(F.lit(".java"), F.lit(".xml")))


def is_type_name_snake(name: Column) -> Column:
    """Whether a type is named in lower_case_with_underscores."""
    return F.coalesce(name.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), F.lit(False))


def package_of(imported: Column) -> Column:
    """The package of an import: without .*, or without the first capitalised part and what follows."""
    return F.regexp_replace(F.regexp_replace(imported, r"\.\*$", ""), r"(^|\.)[A-Z].*$", "")


def without_file_scheme(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^file:(//)?", "")


def _segments(path: Column) -> Column:
    """The names of a path, from left to right, with . and .. resolved as text; .. at the top stays there."""
    none = F.expr("cast(array() as array<string>)")

    def step(done: Column, name: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(name == "..", up).when(name.isin("", "."), done).otherwise(F.concat(done, F.array(name)))

    return F.aggregate(F.split(F.translate(path, "\\", "/"), "/"), none, step)


def relative_path(root: Column | str, path: Column | str) -> Column:
    """path below root with . and .. resolved as text; null if it lies outside or one is null. A relative path starts at root."""
    root, path = (F.col(x) if isinstance(x, str) else x for x in (root, path))
    absolute = F.when(path.startswith("/") | path.startswith("\\"), path).otherwise(F.concat(root, F.lit("/"), path))
    base, full = _segments(root), _segments(absolute)
    below = F.slice(full, F.size(base) + 1, F.greatest(F.size(full) - F.size(base), F.lit(0)))
    inside = F.slice(full, F.lit(1), F.size(base)) == base
    return F.when(root.isNotNull() & path.isNotNull() & inside, F.array_join(below, "/"))


def line_anchor(start: Column, end: Column) -> Column:
    """#L4 or #L4-L9; empty without a start."""
    return F.when(start.isNull(), "").when(end > start, F.format_string("#L%d-L%d", start, end)).otherwise(F.format_string("#L%d", start))


def blob_url(host: str, repo: Column, ref: Column, path: Column, start: Column, end: Column) -> Column:
    """Link to lines of a file at a revision; empty if repo is not owner/name."""
    return F.when(repo.contains("/"), F.concat(F.lit(f"{host}/"), repo, F.lit("/blob/"), ref, F.lit("/"), path, line_anchor(start, end))).otherwise("")
