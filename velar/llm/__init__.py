"""Operations of a training-data pipeline, each one a DataFrame-to-DataFrame function."""
