"""Operations of a training-data pipeline: sharding, extraction, deduplication, mixing, packing, search and privacy."""
