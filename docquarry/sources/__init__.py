"""docquarry.sources"""
