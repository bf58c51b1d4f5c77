"""Sources of documents: files of many formats, parsed in Arrow batches into rows."""
