"""Sequential drift attribution over streams of scored runs, as Spark jobs."""
