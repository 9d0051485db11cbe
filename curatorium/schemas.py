"""Row shapes of the curated data model."""

from pyspark.sql import types as T

# Fixed vocabularies and field names of the data model.
MOODS = ["funny", "exciting", "thoughtful", "relaxing", "emotional", "suspenseful"]
SITUATIONS = ["alone", "date-night", "friends", "family", "easy-watch"]
PACES = ["slow", "medium", "fast"]
WEIGHTS = ["light", "moderate", "heavy"]
ATTENTION = ["easy", "engaged", "immersive"]
STYLES = ["familiar", "different", "adventurous"]

ORDINALS = {
    "pace": PACES,
    "emotional_weight": WEIGHTS,
    "attention_demand": ATTENTION,
    "discovery_style": STYLES,
}

_strings = T.ArrayType(T.StringType())

CATALOGUE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("tmdb_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("moods", _strings),
        T.StructField("situations", _strings),
        T.StructField("filter_languages", _strings),
        T.StructField("pace", T.StringType()),
        T.StructField("emotional_weight", T.StringType()),
        T.StructField("attention_demand", T.StringType()),
        T.StructField("discovery_style", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("why_watch", T.StringType()),
        T.StructField("curiosity_hook", T.StringType()),
        T.StructField("vibe_summary", T.StringType()),
        T.StructField("palette", _strings),
    ]
)

CORPUS_PAGE = T.StructType(
    [
        T.StructField("cell_id", T.StringType()),
        T.StructField("requested_page", T.IntegerType()),
        T.StructField(
            "response",
            T.StructType(
                [
                    T.StructField("page", T.IntegerType()),
                    T.StructField("total_pages", T.IntegerType()),
                    T.StructField("total_results", T.LongType()),
                    T.StructField(
                        "results",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("id", T.LongType()),
                                    T.StructField("title", T.StringType()),
                                    T.StructField("release_date", T.StringType()),
                                    T.StructField("vote_count", T.LongType()),
                                    T.StructField("vote_average", T.DoubleType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
    ]
)
