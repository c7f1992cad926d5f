"""Operations of a large-scale training-data pipeline, each as Spark jobs over whole tables."""
