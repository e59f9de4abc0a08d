"""tablemill: media-catalogue analytics and corpus preparation as Spark jobs."""
