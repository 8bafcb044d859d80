"""The import pipeline: clean, map names, report quality."""

from ..operators import clean, mapping, profile


def import_pipeline(df, name="table", order_by=None):
    """{"data", "steps", "mapping", "quality"}: lazily planned DataFrames; a table without columns is an error."""
    if not df.columns:
        raise ValueError("nothing to import")
    data = clean.clean(df, order_by=order_by)
    return {
        "data": data,
        "steps": clean.cleaning_report(clean.clean_names(df)),
        "mapping": mapping.semantic_map(mapping.catalog_columns({name: data}), mapping.lexicon(df.sparkSession)),
        "quality": profile.quality_report(data),
    }
