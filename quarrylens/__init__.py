"""Repository-intelligence relations and questions as Spark plans."""
