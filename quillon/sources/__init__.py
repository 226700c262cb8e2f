"""Reading and writing files of documents."""
