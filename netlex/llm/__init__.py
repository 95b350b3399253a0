"""Training-data operators: licences, token files, packing, media, duplicates, leaks, quality, chat."""
